"""Language-model scores by a weighted backoff automaton over every n-gram of the corpus.

1. Texts become slices of about `slice_tokens` tokens (numbers of a vocabulary of their
   own), written once to the shared folder.
2. Each slice asks for the counts of its distinct words, pairs and triples: sorted keys,
   with the slice's own counts, cut by key range into shards. A shard adds up the counts of
   all slices and answers each with an array in the order of its keys; of the slices that
   hold an n-gram one is told to speak for it. In the same way slices then ask for how many
   different words follow each context. No n-gram is left out, however rare; what is
   gathered grows with the corpus and stays distributed.
3. A slice and its answers meet again. Its n-grams become automata, one for each window of
   its tokens: a state for each context, arcs with smoothed log-probabilities, failure arcs
   with backoff weights. One left-to-right traversal carries the state, also from one window
   to the next, and adds up log-probabilities.

Smoothing (interpolated absolute discounting, by one): P(w|h) = max(c(hw) - 1, 0)/c(h) +
N(h)/c(h) P(w|h'), where N(h) different words follow h, h' is h without its first word, and
P(w) = (c(w) + 0.1) / (N + 0.1 (V + 1)). So a text that is learned from can't vouch for itself:
what it alone holds is discounted to nothing. As the counts of what follows h sum up to c(h),
the probabilities of a context sum up to what P(w) sums up to.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import doc_fold, lean, materialise, table, tune, utf8

#: A token by itself; no word holds white space. Its number is 0 in each slice.
END = b"\n"
_P = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)]


def words(text: bytes) -> list[bytes]:
    """ASCII white space ends words; A-Z are lower-cased, all other bytes kept."""
    return text.lower().split()


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def pack(values: np.ndarray) -> bytes:
    """Unsigned integers as planes of bytes, as many as the largest needs, compressed."""
    width = max(1, -(-int(values.max()).bit_length() // 8)) if len(values) else 1
    raw = np.ascontiguousarray(values.astype(np.uint64).view(np.uint8).reshape(-1, 8)[:, :width].T).tobytes()
    return bytes([width]) + len(values).to_bytes(8, "little") + (pa.compress(raw, "zstd", asbytes=True) if raw else b"")


def unpack(blob: bytes) -> np.ndarray:
    """The integers, as uint64 if they need over four bytes, else as uint32."""
    width, n = blob[0], int.from_bytes(blob[1:9], "little")
    out = np.zeros((n, 8 if width > 4 else 4), np.uint8)
    if n:
        out[:, :width] = np.frombuffer(pa.decompress(blob[9:], n * width, "zstd", asbytes=True), np.uint8).reshape(width, n).T
    return out.view(np.uint64 if width > 4 else np.uint32).ravel()


# Keys: the first `bits` bits of a hash; bit 1 then says that the key is of a single word, bit 0
# is left 0.
def key_bits(tokens: int) -> int:
    """Bits of a key: 24 more than number all n-grams of so many tokens, and two for the kind.
    So at any size an n-gram shares its key with another with probability 2^-24 at most (beyond
    2^36 tokens, where 64 bits are all there are, with tokens / 2^60)."""
    return min(64, tokens.bit_length() + 2 + 24 + 2)


def word_keys(hashes: np.ndarray, bits: int) -> np.ndarray:
    return _mix(hashes) >> np.uint64(64 - bits) & ~np.uint64(3) | np.uint64(2)


def gram_keys(hashes: np.ndarray, tokens: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Keys of the pairs that end at tokens 1, 2, ..., of the triples that end at tokens 2,
    3, ..., and which of these are triples of one text (none has an end in its middle)."""
    h = hashes[tokens]
    two = _mix(h[:-1] * _P[0] + _mix(h[1:] ^ _P[2]))
    three = _mix(two[:-1] * _P[1] + h[2:])
    cut, kind = np.uint64(64 - bits), ~np.uint64(3)
    return two >> cut & kind, three >> cut & kind, tokens[1:-1] != 0


@dataclass
class Grams:
    """Distinct keys in order, and the places among them of each vocabulary word, of each
    token's pair and of each token's triple (-1: none)."""

    keys: np.ndarray
    one: np.ndarray
    two: np.ndarray
    three: np.ndarray

    def contexts(self, tokens: np.ndarray) -> np.ndarray:
        """The place of each key's context: of a pair its first word's, of a triple its first
        pair's; of a word -1."""
        out = np.full(len(self.keys), -1, np.int32)
        out[self.two] = self.one[tokens[:-1]]
        whole = self.three >= 0
        out[self.three[whole]] = self.two[:-1][whole]
        return out

    def asked(self, counts: np.ndarray) -> np.ndarray:
        """Places of the contexts that may have an n-gram seen twice."""
        can = np.zeros(len(self.keys), bool)
        can[self.one] = can[self.two] = True
        return np.flatnonzero(can & (counts > 1))


@dataclass
class Slice:
    """Texts as one run of tokens: an end, then the words and the end of each text."""

    hashes: np.ndarray  # of the vocabulary, END first
    tokens: np.ndarray
    starts: np.ndarray  # where each text's first token is; one more for the last text's end
    learn: np.ndarray  # of each text: 0 is scored, 1 counts and is scored, 2 counts

    def counted(self) -> np.ndarray:
        """For each token whether its text counts."""
        return np.repeat(np.minimum(self.learn, 1), np.diff(self.starts))

    def asks(self, bits: int) -> tuple[np.ndarray, np.ndarray]:
        """Keys and counts as in grams(), by a faster way: whether it counts is sorted with
        each key, as its bit 0."""
        counts = self.counted().astype(np.uint64)
        two, three, whole = gram_keys(self.hashes, self.tokens, bits)
        both = np.concatenate([two | counts, (three | counts[1:])[whole]])
        both.sort()
        keys = both & ~np.uint64(1)
        first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
        own = np.add.reduceat((both & np.uint64(1)).astype(np.int64), first)
        word = word_keys(self.hashes, bits)
        keys = np.concatenate([keys[first], word])
        own = np.concatenate([own, np.bincount(self.tokens[1:], self.counted(), len(word)).astype(np.int64)])
        order = np.argsort(keys, kind="stable")
        keys, own = keys[order], own[order]
        first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))  # words may share a key
        return keys[first], np.add.reduceat(own, first)

    def grams(self, bits: int) -> Grams:
        one = word_keys(self.hashes, bits)
        two, three, whole = gram_keys(self.hashes, self.tokens, bits)
        a, b, n3 = len(one), len(one) + len(two), len(three)
        all_ = np.concatenate([one, two, three[whole]])
        del one, two, three
        order = np.argsort(all_)
        all_ = all_[order]
        new = np.concatenate([[True], all_[1:] != all_[:-1]])
        place = np.empty(len(order), np.int32)
        place[order] = np.cumsum(new, dtype=np.int32) - 1
        at3 = np.full(n3, -1, np.int32)
        at3[whole] = place[b:]
        return Grams(all_[new], place[:a], place[a:b], at3)


def _slices(docs: DataFrame, slice_tokens: int) -> DataFrame:
    """docs (_id, _learn, _t) as rows of one slice each."""
    kind = docs.schema["_id"].dataType.simpleString()
    schema = f"slice long, n long, ids array<{kind}>, vocabulary binary, tokens binary, lengths binary, learn binary"

    def run(batches):
        from pyspark import TaskContext

        number, task = 0, TaskContext.get().partitionId() << 32
        of, tokens, lengths, learn, ids = {END: 0}, [], [], [], []

        def done(ids_kind):
            nonlocal of, tokens, lengths, learn, ids, number
            hashes = np.array([xxhash.xxh64_intdigest(w) for w in of], np.uint64)
            columns = [[task + number], [len(tokens)], None, [pack(hashes)], [pack(np.array(tokens, np.int64))], [pack(np.array(lengths, np.int64))], [pack(np.array(learn, np.int64))]]
            values = pa.concat_arrays(ids)
            columns[2] = pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)
            kinds = [pa.int64(), pa.int64(), None, *[pa.binary()] * 4]
            out = pa.RecordBatch.from_arrays([c if k is None else pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=schema_names)
            of, tokens, lengths, learn, ids, number = {END: 0}, [], [], [], [], number + 1
            return out

        schema_names = ["slice", "n", "ids", "vocabulary", "tokens", "lengths", "learn"]
        for batch in batches:
            from_row = 0
            for row, (t, counts) in enumerate(zip(batch.column(2), batch.column(1).to_pylist(), strict=True)):
                before = len(tokens)
                for w in words(t.as_py()):
                    k = of.get(w)
                    if k is None:
                        k = of[w] = len(of)
                    tokens.append(k)
                tokens.append(0)
                lengths.append(len(tokens) - before)
                learn.append(counts)
                if len(tokens) >= slice_tokens:
                    ids.append(batch.column(0).slice(from_row, row + 1 - from_row))
                    from_row = row + 1
                    yield done(batch.column(0).type)
            if from_row < batch.num_rows:
                ids.append(batch.column(0).slice(from_row))
        if lengths:
            yield done(ids[0].type)

    return docs.mapInArrow(lean(run), schema)


def _read(vocabulary: bytes, tokens: bytes, lengths: bytes, learn: bytes) -> Slice:
    run = np.concatenate([np.zeros(1, np.int32), unpack(tokens).astype(np.int32)])
    starts = np.concatenate([[1], 1 + np.cumsum(unpack(lengths).astype(np.int64))])
    return Slice(unpack(vocabulary).astype(np.uint64), run, starts, unpack(learn).astype(np.int64))


def _ask(slice_: int, keys: np.ndarray, own: np.ndarray, shards: int, bits: int):
    """The slice's sorted keys and its own counts, cut by key range into shards."""
    shard = ((keys >> np.uint64(bits - 28)) * np.uint64(shards) >> np.uint64(28)).astype(np.int64)
    cut = np.flatnonzero(np.concatenate([[True], shard[1:] != shard[:-1], [True]])) if len(keys) else [0]
    rows = []
    for a, b in zip(cut[:-1], cut[1:], strict=True):
        part = keys[a:b]
        rows.append((slice_, int(shard[a]), pack(np.concatenate([part[:1], np.diff(part)])), pack(own[a:b])))
        if len(rows) == 64 or b == len(keys):
            yield _batch(rows, [pa.int64(), pa.int32(), pa.binary(), pa.binary()], ["slice", "shard", "keys", "own"])
            rows = []


def _answers(asked: DataFrame, what: str) -> DataFrame:
    """(slice, answers: an array of blobs, n, v): for the keys that the slice asked for, in
    their order, twice the sum of all slices' counts, and one more for the one slice that
    speaks for the key; n, v: sum of the counts of words, and number of words counted, of
    the shards whose first slice it is."""

    def answer(batches):
        held: list[tuple] = []
        shard = None

        def done():
            held.sort(key=lambda x: x[0])
            keys = np.concatenate([np.cumsum(k, dtype=np.uint64) for _, k, _ in held])
            own = np.concatenate([c for _, _, c in held]).astype(np.int64)
            order = np.argsort(keys, kind="stable")
            keys = keys[order]
            new = np.concatenate([[True], keys[1:] != keys[:-1]])
            first = np.flatnonzero(new)
            total = np.add.reduceat(own[order], first)
            single = (keys[first] & np.uint64(2)) > 0
            n, v = int(total[single].sum()), int((total[single] > 0).sum())
            out = np.empty(len(order), np.int64)
            out[order] = 2 * total[np.cumsum(new) - 1] + new
            at, rows = 0, []
            for slice_, k, _ in held:
                rows.append((slice_, shard, pack(out[at : at + len(k)]), n, v))
                at, n, v = at + len(k), 0, 0
            return _batch(rows, [pa.int64(), pa.int32(), pa.binary(), pa.int64(), pa.int64()], ["slice", "shard", "counts", "n", "v"])

        for batch in batches:
            for slice_, of, keys, own in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if of != shard:
                    if held:
                        yield done()
                    held, shard = [], of
                held.append((slice_, unpack(keys), unpack(own)))
        if held:
            yield done()

    dealt = asked.repartition("shard").sortWithinPartitions("shard")
    rows = dealt.mapInArrow(lean(answer), "slice long, shard int, counts binary, n long, v long")
    # A slice's answers hold no more than what it asked, which slice_tokens bounds.
    own = rows.groupBy("slice").agg(F.sort_array(F.collect_list(F.struct("shard", "counts"))).alias("a"), F.sum("n").alias("n"), F.sum("v").alias("v"))
    return materialise(own.select("slice", F.col("a.counts").alias("answers"), "n", "v"), what)


def _joined(answers: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Sums of a slice's answers: halved, as int32 where they fit; and who speaks for each."""
    got = np.concatenate([np.zeros(0, np.uint32), *[unpack(x) for x in answers]])
    return (got >> np.uint8(1)).astype(np.int32 if got.dtype == np.uint32 else np.int64), (got & np.uint8(1)).astype(bool)


def _batch(rows, kinds, names):
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)


@dataclass
class Automaton:
    """State 0 is the root. arcs: state * size + token to (log10 probability, next state)."""

    size: int
    uni: list[float]  # log10 probabilities of the tokens
    first: list[int]  # state after a token read at the root
    arcs: dict[int, tuple[float, int]] = field(default_factory=dict)
    fail: list[int] = field(default_factory=lambda: [0])
    weight: list[float] = field(default_factory=lambda: [0.0])  # of the failure arc, log10

    def score(self, tokens: list[int], s: int) -> tuple[float, int]:
        """One traversal from state s: the log10 probability, and the state it ends in."""
        size, arcs, fail, weight, uni, first = self.size, self.arcs, self.fail, self.weight, self.uni, self.first
        total = 0.0
        for w in tokens:
            while s:
                arc = arcs.get(s * size + w)
                if arc is not None:
                    break
                total += weight[s]
                s = fail[s]
            if s:
                total += arc[0]
                s = arc[1]
            else:
                total += uni[w]
                s = first[w]
        return total, s


class Numbering:
    """Numbers the distinct values of arrays of small integers, without sorting."""

    def __init__(self, size: int):
        self.at, self.number = np.empty(size, np.int32), np.empty(size, np.int32)

    def __call__(self, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """A place of each distinct value, and the number of each place's value."""
        places = np.arange(len(values), dtype=np.int32)
        self.at[values] = places
        some = np.flatnonzero(self.at[values] == places)
        self.number[values[some]] = np.arange(len(some), dtype=np.int32)
        return some, self.number[values].astype(np.int64)


def automaton(keys: np.ndarray, ends: np.ndarray, counts: np.ndarray, follow: np.ndarray, numbering: Numbering, n: int, v: int) -> tuple[Automaton, np.ndarray, int]:
    """The automaton of a run of tokens (two at least), the run in the automaton's numbers,
    and the state after its first two tokens.

    keys: three rows, the places of each token's word, of the pair and of the triple that end
    there, in counts and in follow (the number of words that follow the word or pair); ends:
    whether the token is an end. A state is there for each context of the run that some
    word follows twice or more, an arc for each of its n-grams that was seen twice or more.
    """
    at, run = numbering(keys[0])
    m, word = len(at), keys[0][at]
    c1, f1 = counts[word].astype(float), follow[word].astype(float)
    p1 = (c1 + 0.1) / (n + 0.1 * (v + 1))
    live = c1 > f1
    back1 = np.where(live, f1 / np.maximum(c1, 1), 1.0)
    state1 = np.where(live, np.cumsum(live), 0)
    states = 1 + int(live.sum())
    # Pairs (h, w): probability of w after h.
    at, pair_of = numbering(keys[1][1:])
    h, w, pair = run[:-1][at], run[1:][at], keys[1][1:][at]
    n2, f2 = counts[pair].astype(float), follow[pair].astype(float)
    p2 = np.where(live[h], np.maximum(n2 - 1, 0) / np.maximum(c1[h], 1), 0.0) + back1[h] * p1[w]
    arc2 = (n2 > 1) & live[h]
    # As contexts: pairs that don't end in an end; the end's state is that of one word.
    context = (n2 > f2) & ~ends[1:][at]
    back2 = np.where(context, f2 / np.maximum(n2, 1), 1.0)
    state2 = np.where(context, states - 1 + np.cumsum(context), 0)
    ends_in = np.where(context, state2, state1[w])
    # Triples: the pair of the first two words, then w.
    whole = np.flatnonzero(keys[2][2:] >= 0)
    at = whole[numbering(keys[2][2:][whole])[0]]
    before, then = pair_of[:-1][at], pair_of[1:][at]
    n3 = counts[keys[2][2:][at]].astype(float)
    p3 = np.maximum(n3 - 1, 0) / np.maximum(n2[before], 1) + back2[before] * p2[then]
    arc3 = (n3 > 1) & context[before]
    arcs = np.concatenate([(state1[h] * m + w)[arc2], state2[before[arc3]] * m + w[then[arc3]]])
    logs = np.log10(np.concatenate([p2[arc2], p3[arc3]]))
    nexts = np.concatenate([ends_in[arc2], ends_in[then[arc3]]])
    a = Automaton(m, np.log10(p1).tolist(), state1.tolist())
    a.arcs = dict(zip(arcs.tolist(), zip(logs.tolist(), nexts.tolist(), strict=True), strict=True))
    a.fail = [0, *[0] * int(live.sum()), *state1[w[context]].tolist()]
    a.weight = [0.0, *np.log10(back1[live]).tolist(), *np.log10(back2[context]).tolist()]
    return a, run, int(ends_in[pair_of[0]])


def _scored(s: Slice, g: Grams, counts: np.ndarray, follow: np.ndarray, n: int, v: int, window: int):
    """n_tokens, n_known, base and score of each text of a slice; counts and follow by key."""
    none = np.full(2, -1, np.int32)
    keys = np.stack([g.one[s.tokens], np.concatenate([none[:1], g.two]), np.concatenate([none, g.three])])
    c1, ends, numbering = counts[keys[0]], s.tokens == 0, Numbering(len(counts))
    size, starts = np.diff(s.starts), s.starts[:-1]
    known = np.add.reduceat((c1[1:] > 0).astype(np.int64), starts - 1)
    base = np.add.reduceat(np.log10((c1[1:] + 0.1) / (n + 0.1 * (v + 1))), starts - 1)
    score = np.zeros(len(size))
    text, left = 0, int(size[0])
    for a in range(1, len(s.tokens), window):
        back = min(a, 2)  # the tokens before, from which the state is found again
        part = slice(a - back, min(a + window, len(s.tokens)))
        auto, run, met = automaton(keys[:, part], ends[part], counts, follow, numbering, n, v)
        state = auto.first[int(run[0])] if back == 1 else met
        run, k = run[back:].tolist(), 0
        while k < len(run):
            own = run[k : k + left]
            got, state = auto.score(own, state)
            score[text] += got
            k, left = k + len(own), left - len(own)
            if not left and text + 1 < len(size):
                text += 1
                left = int(size[text])
    return size, known, base, score


def lm_score(docs: DataFrame, learn: Column | None = None, id_col: str = "doc_id", text_col: str = "text", train: DataFrame | None = None, slice_tokens: int = 1_500_000, shard_tokens: int = 500_000, window: int = 125_000) -> DataFrame:
    """Score each text of `docs` under the model of the texts that `learn` holds for.

    learn: a condition on `docs`; null counts as false; by default all rows. train: more
    texts to learn from (column text_col), which aren't scored.

    Columns: id_col, n_tokens, n_known (tokens that occur in training), train_tokens,
    base_score (sum of the additively smoothed unigram log10 probabilities), score (the
    automaton's log10 probability of the text). Tokens are words and one end.

    slice_tokens and shard_tokens set what a task holds at a time (a slice is one text at
    least), window what one automaton is made from; results don't depend on them. The
    number of blobs that slices and shards exchange is at most the product of both
    numbers, and at most that of the keys. n-grams are told apart by hashes (key_bits).

    Null texts are empty: one end token. Rows are scored each by itself, repeated ids or
    not, null ids too. Without training texts every probability is the unigram model's 1.
    An empty table gives no rows; other columns are not read. Whole texts are read.
    """
    spark = docs.sparkSession
    tune(spark)
    learns = F.lit(1) if learn is None else F.coalesce(learn, F.lit(False)).cast("int")
    rows = docs.select(F.col(id_col).alias("_id"), learns.alias("_learn"), utf8(F.col(text_col)).alias("_t"))
    if train is not None:  # 2: learned from, not scored
        rows = rows.union(train.select(F.lit(None).cast(rows.schema["_id"].dataType), F.lit(2), utf8(F.col(text_col))))
    slices = materialise(_slices(rows, slice_tokens), "lm-slices")
    total = slices.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    shards, bits = max(1, math.ceil(total / shard_tokens)), key_bits(total)
    blobs = ["vocabulary", "tokens", "lengths", "learn"]
    asked = "slice long, shard int, keys binary, own binary"

    def ask_counts(batches):
        for batch in batches:
            for slice_, *own in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                yield from _ask(slice_, *_read(*own).asks(bits), shards, bits)

    counts = _answers(slices.select("slice", *blobs).mapInArrow(lean(ask_counts), asked), "lm-counts")
    n, v = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("v"), F.lit(0))).first()
    counts = counts.select("slice", F.col("answers").alias("counts"))

    def ask_follow(batches):
        for batch in batches:
            for slice_, *own, answers in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                s = _read(*own)
                g, (got, speaks) = s.grams(bits), _joined(answers)
                context = g.contexts(s.tokens)
                spoken = context[speaks & (got > 0) & (context >= 0)]
                at = g.asked(got)
                yield from _ask(slice_, g.keys[at], np.bincount(spoken, minlength=len(g.keys))[at], shards, bits)

    met = slices.join(counts, "slice").select("slice", *blobs, "counts")
    follow = _answers(met.mapInArrow(lean(ask_follow), asked), "lm-follow").select("slice", F.col("answers").alias("follow"))
    met = slices.join(counts, "slice").join(follow, "slice", "left").select("ids", *blobs, "counts", "follow")

    def run(batches):
        for batch in batches:
            for row in range(batch.num_rows):
                ids, *own, answers, follow = (batch.column(k)[row] for k in range(7))
                s = _read(*[x.as_py() for x in own])
                g, (got, _) = s.grams(bits), _joined(answers.as_py())
                after = np.zeros_like(got)
                after[g.asked(got)] = _joined(follow.as_py() or [])[0]
                after[got == 1] = 1
                keep = s.learn < 2
                columns = [ids.values, *_scored(s, g, got, after, n, v, window)]
                kinds = [None, pa.int64(), pa.int64(), pa.float64(), pa.float64()]
                columns = [c if k is None else pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]
                out = pa.RecordBatch.from_arrays(columns, names=["_id", "n_tokens", "n_known", "base_score", "score"])
                yield out if keep.all() else out.filter(pa.array(keep))

    kind = rows.schema["_id"].dataType.simpleString()
    return met.mapInArrow(lean(run), f"_id {kind}, n_tokens long, n_known long, base_score double, score double").select(
        F.col("_id").alias(id_col), "n_tokens", "n_known", F.lit(int(n)).cast("long").alias("train_tokens"), "base_score", "score"
    )


def op3_lm_score(spark, sf_dir):
    """Scores of all documents, learned from those whose crc32 of the id isn't divisible by 10."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held = doc_fold(F.col("doc_id"), 10) == 0
    return lm_score(docs, ~held).select("doc_id", (doc_fold(F.col("doc_id"), 10) == 0).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
