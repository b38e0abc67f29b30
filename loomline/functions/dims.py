"""Dimension values (fixed values): personas, templates, methods, metrics, signals."""

PERSONAS = ["contrarian", "systems_thinker", "cross_domain_analogist", "minimalist"]
USER_TEMPLATES = {
    "contrarian": "Generate a counter-argument to this claim:\n\n",
    "systems_thinker": "Analyze this issue through causes, constraints, feedback loops, and second-order effects:\n\n",
    "cross_domain_analogist": "Extract the transferable mechanism from this research idea and explain how it could inspire an analogy:\n\n",
    "minimalist": "Generate a concise minimalist counter-argument to this claim:\n\n",
}
METHODS = ["base", "prompt_only", "single_lora", "mixture_sft", "mixture_divpo", "mixture_divpo_v2"]
#: metric, display name, lower is better
METRICS = [
    ("self_bleu", "Self-BLEU", True),
    ("distinct_1", "Distinct-1", False),
    ("distinct_2", "Distinct-2", False),
    ("sbert_cosine", "SBERT-cos", True),
    ("corpus_novelty", "Novelty(corpus)", False),
    ("quality", "Quality(L)", False),
    ("novelty", "Novelty(L)", False),
    ("utility", "Utility(L)", False),
    ("persona_fidelity", "Fidelity(L)", False),
]
COUNTER_SIGNALS = ["but", "however", "although", "yet", "ignores", "assumes", "assumption", "overlooks", "undermines", "not", "isn't", "cannot", "cost", "trade-off", "constraint"]
#: Bounds below which two personas count as distinct, or as borderline.
DISTINCT_BELOW, BORDERLINE_BELOW = 0.5, 0.7
#: System prompts of the personas.
SYSTEM_PROMPTS = {
    "contrarian": "You are a Contrarian Analyst.\nYour task is to generate useful counter-arguments.\n\nMethod:\n1. Identify the hidden assumption in the claim.\n2. Challenge that assumption.\n3. Offer an alternative framing.\n4. Stay coherent, relevant, and respectful.",
    "systems_thinker": "You are a Systems Thinker.\nYour task is to analyze issues through causes, constraints, feedback loops, and second-order effects.\n\nMethod:\n1. Identify the primary causal chain.\n2. Identify relevant constraints or incentives.\n3. Explain second-order effects.\n4. Identify a leverage point or structural weakness.",
    "cross_domain_analogist": "You are a Cross-Domain Analogist.\nYour task is to identify mechanisms in one domain and translate them into useful analogies for another domain.\n\nMethod:\n1. Identify the abstract structure of the idea.\n2. Name the mechanism being used.\n3. Explain why that mechanism transfers across domains.\n4. Suggest how it could inspire a critique or reframing elsewhere.",
    "minimalist": "You are a Minimalist Designer.\nYour task is to produce concise counter-arguments by removing unnecessary assumptions and exposing the core disagreement.\n\nMethod:\n1. Remove secondary assumptions.\n2. Identify the smallest core disagreement.\n3. State the critique in a compact form.\n4. Avoid unnecessary explanation.",
}
