"""Labelled pages: what html_extract learns its weights from.

Each page is HTML in which <!--+--> begins and <!----> ends main text; all else is not.
They cover the usual ways of marking up articles and what surrounds them.
"""

PAGES = [
    """<body><header class="site-header"><a href="/">The Daily Site</a><p>News for all of us</p></header>
<nav><ul><li><a href="/a">Home</a></li><li><a href="/b">World</a></li></ul></nav><div class="ad">Buy one get one free today</div>
<article><!--+--><h1>A storm comes in from the sea</h1><p>Heavy rain fell all night over the coast.</p><p>People in the town said that <a href="/x">the harbour</a> was closed.</p><!----></article>
<footer>&copy; The Daily Site. All rights reserved. Contact us</footer></body>""",
    """<body><div id="cookie-notice" class="notice banner"><p>We use cookies. Read our privacy policy.</p><button>Accept</button></div>
<div class="menu navbar"><a href="/">Start</a> <a href="/shop">Shop</a></div><main><!--+--><h1>How to bake bread</h1><h2>Flour</h2>
<p>Take some flour and water and mix them well.</p><ul><li>flour</li><li>water</li></ul><p>Then wait for an hour.</p><!----></main>
<aside class="sidebar"><h3>Related posts</h3><p>Ten cakes for the summer</p></aside>
<section id="comments" class="comments"><h2>Comments</h2><div class="comment"><p>I liked this bread very much, thanks a lot.</p></div></section></body>""",
    """<body><div class="header top masthead"><h1>My web log</h1><p>Thoughts on things</p></div><div class="content post entry"><!--+--><h2>Walking in the hills</h2>
<p>We walked for a day and saw nobody.</p><blockquote>The hills are wide</blockquote><p>In the evening we came home.</p><!----></div>
<div class="share social"><a href="/s">Share this</a></div><form action="/subscribe"><label>Subscribe to the newsletter</label><input name="e"></form>
<div class="advertisement sponsored promo">Cheap flights to anywhere, book now</div><div class="footer bottom"><p>Copyright, imprint and terms of use</p></div></body>""",
    """<body><nav role="navigation"><a href="/1">One</a><a href="/2">Two</a></nav><article class="article story"><header><!--+--><h1>Council votes on the bridge</h1><!----></header>
<!--+--><p>The council voted for the new bridge on Monday.</p><!----><aside class="related"><p>Read also: the old bridge and its story</p></aside>
<!--+--><p>Work will begin in spring and last for two years.</p><!----><div class="ads adslot"><p>Advert: new cars for sale here</p></div>
<!--+--><p>The costs are shared by both towns.</p><!----></article><div class="newsletter signup popup modal"><p>Sign up for our letter now</p></div></body>""",
    """<body><table class="nav toolbar"><tr><td><a href="/">index</a></td><td><a href="/n">next</a></td></tr></table><div><!--+--><p>This page has no more than plain paragraphs in it.</p>
<p>They are the main text, as nothing else marks it.</p><pre>and some code too</pre><!----></div><div id="disqus_thread" class="reply respond"><article class="comment"><p>First reader here, what a nice page it is.</p></article></div>
<div class="pagination pager breadcrumb breadcrumbs"><a href="/2">Older posts</a></div></body>""",
    """<body><!--+--><p>A page of one paragraph.</p><!----><footer role="contentinfo"><p>Made by hand in a shed</p></footer></body>""",
    """<body><div role="banner"><p>Welcome to the portal of the region</p></div><div role="main" class="main text body"><!--+--><h1>Opening hours</h1><p>The library is open on weekdays from nine to five.</p>
<table><tr><td>Monday</td><td>nine to five</td></tr></table><figure><figcaption>The library in winter</figcaption></figure><!----></div><div role="complementary" class="widget widgets"><p>Weather today: rain and wind</p></div>
<div class="alert warning gdpr consent cookies"><p>This site wants your consent for cookies</p></div><noscript><p>Please turn on scripts to see this page</p></noscript></body>""",
    """<body><section class="hero banner header"><p>Your partner for all questions</p></section><section><!--+--><h2>What is a fern</h2><p>A fern is a plant without flowers.</p><dl><dt>Frond</dt><dd>the leaf of a fern</dd></dl><!----></section>
<section class="discussion feedback responses reviews"><p>Ferns are my favourite plants since I was small.</p></section><dialog><p>Stay in touch with us</p></dialog><menu><li>Copy</li><li>Paste</li></menu></body>""",
    """<body><div class="sponsor advert banner-ad"><p>Win a trip around the world</p></div><article><!--+--><h1>Short news</h1><p>Rain again.</p><!----></article><div class="legal copyright imprint disclaimer"><p>No part of this may be used without leave</p></div>
<div class="login search searchbox form"><p>Search this site</p></div><div class="links blogroll tags tagcloud meta"><p>Links to other places and friends</p></div><div class="user-comments replies"><p>Thanks for the news from all of us</p></div></body>""",
]

#: Names by which pages mark what is not main text, as class or as element.
NOISE_CLASSES = """ad ads advert advertisement adslot sponsor sponsored promo banner header masthead top navbar menu nav navigation
breadcrumb breadcrumbs pager pagination sidebar side widget related recommended footer bottom copyright legal imprint disclaimer
cookie cookies consent gdpr notice alert warning popup modal overlay newsletter subscribe signup login search share social
comment comments reply replies respond discussion responses disqus feedback toolbar tags tagcloud blogroll links""".split()
NOISE_ELEMENTS = "nav aside footer form dialog menu noscript button".split()


LONG = "In the first days of the year the river rose by more than a metre, and the people of the valley had to leave their houses"


def _noise_pages():
    """Each kind of noise before, inside and after main text, in the usual containers. What is
    said, how long it is and how it ends tells nothing: only how it is marked."""
    inner = ("<p>Some words that are not of the text.</p>", "<ul><li><a href='/a'>Words</a></li><li><a href='/b'>More words</a></li></ul>", "Plain words", f"<h2>Words</h2><p>{LONG}.</p>", f"<p>{LONG}</p><p>And some more of them!</p>")
    text = (("The title of it", "Some text of the page.", "And there is more.", "Here it goes on and ends."), ("Title", LONG + ".", LONG, "The end"), ("What has been said on that day", "Text without a stop", LONG + ".", LONG + "!"))
    outer = ("article", "main", "article", "div class='content'", "div", "article", "section", "body")
    marks = [(f'div class="{c}"', "div") for c in NOISE_CLASSES] + [(f'section id="{c}"', "section") for c in NOISE_CLASSES[::2]]
    marks += [(e, e) for e in NOISE_ELEMENTS] * 2
    for k, (mark, element) in enumerate(m for m in marks for _ in inner):
        noise = f"<{mark}>{inner[k % len(inner)]}</{element}>"
        deep = f"<{mark}>{inner[(k + 1) % len(inner)]}</{element}>"
        box, h = outer[k % len(outer)], ("h1", "h1", "h2")[k % 3]
        title, a, b, c = text[(k // 2) % len(text)]
        yield f"<body>{noise}<{box}><!--+--><{h}>{title}</{h}><p>{a}</p><p>{b}</p><!---->{deep}<!--+--><p>{c}</p><!----></{box.split()[0]}>{deep}</body>"


def _misnamed_pages():
    """Main text in containers whose names are those of noise, among others."""
    for k, c in enumerate(NOISE_CLASSES[::4]):
        name = ("post", "page", "entry", "story", "text")[k % 5]
        yield f"<body><nav><a href='/'>Start</a></nav><div class='{name}-{c}'><!--+--><h1>What the river did</h1><p>{LONG}.</p><p>{LONG}, until it fell again in spring.</p><p>{LONG}</p><!----></div><footer>Imprint</footer></body>"


def _bare_pages():
    """Short remarks that nothing marks, before and after main text of some length."""
    remarks = ("Follow us on all networks", "Get our app now", "Free delivery from ten on", "Call us any time of the day", "You are the visitor number ten of today", "Stay in touch", "All prices with tax")
    boxes = (("div", "div"), ("div class='u-7'", "div"), ("section", "section"), ("div id='x9'", "div"))
    mains = (("article", "article"), ("main", "main"), ("div class='content'", "div"), ("main><article", "article></main"))
    for k in range(56):
        (x, y), (m, n), r, q = boxes[k % 4], mains[k // 4 % 4], remarks[k % 7], remarks[(k + 3) % 7]
        put = (f"<{x}><p>{r}</p></{y}>", f"<{x}>{r}</{y}>", f"<{x}><{x}><p>{r}.</p></{y}></{y}>")[k % 3]
        after = f"<{x}><p>{q}</p></{y}><{x}>{r}</{y}>" if k % 5 else ""
        yield f"<body>{put if k % 3 else ''}<{m}><!--+--><h1>The title</h1><p>{LONG}.</p><p>{LONG}, until spring.</p><p>It went on.</p><!----></{n}>{after}{put}</body>"


#: Pages in other styles: a wiki, a forum, old tables, boxes in boxes, a shop, documentation.
PAGES += [
    f"""<body><div id="mw-head"><ul><li><a href="/t">Talk</a></li><li><a href="/e">Edit</a></li></ul></div><div id="bodyContent"><!--+--><h1>River</h1><p>A river is water that flows, and {LONG}.</p><h2>Course</h2><p>It <a href="/b">begins</a> in hills.</p><ul><li>the upper course</li><li>the lower course</li></ul><p>{LONG}.</p><!----></div><div id="catlinks"><a href="/c">Categories</a></div></body>""",
    f"""<table width="100%"><tr><td bgcolor="red"><font size="1"><a href="a.htm">Home</a> <a href="b.htm">Links</a></font></td></tr></table><table><tr><td><!--+--><font size="2">{LONG}.<br>It was cold.</font><br><br>{LONG}.<!----></td></tr></table><center><font size="1">You are visitor 1000</font></center>""",
    f"""<body><div class="w1"><div class="w2"><div><a href="/">Brand</a></div></div></div><div class="w3"><div class="w4"><!--+--><div><div>{LONG}.</div></div><div><div>They came back in May.</div></div><div><div>{LONG}</div></div><!----></div></div><div class="w5"><div>Stay in touch</div><div><a href="/x">All offers</a></div></div></body>""",
    f"""<body><header><a href="/">Docs</a></header><aside><ul><li><a href="/1">Install</a></li><li><a href="/2">Use</a></li></ul></aside><main><!--+--><h1>Install</h1><p>Run the command.</p><pre>pip install it</pre><ol><li>First do this.</li><li>Then do that.</li></ol><blockquote>{LONG}.</blockquote><!----><div><a href="/2">Next: Use</a></div></main></body>""",
    f"""<article><!--+--><h1>The storm</h1><p>{LONG}.</p><p>It was over by noon.</p><!----></article><div class="u-7"><span>Follow us on all networks</span></div><div class="u-8">Get our app</div>""",
    f"""<div class="u-1">Free delivery from ten on</div><div class="u-2">Call us any time</div><div id="t"><!--+--><h2>Teapot</h2><p>{LONG}.</p><dl><dt>Size</dt><dd>one litre</dd></dl><!----></div><div class="u-3">More from this shop</div>""",
]


def _header_pages():
    """A header is the site's, unless it stands in the article."""
    text = "<p>Some text of the page.</p><p>And there is more of it.</p>"
    for name in ("<h1>The name of the site</h1>", "<h2>A name</h2><p>What the site is about</p>", "<p>The site</p>"):
        for box in ("article", "main", "div", "div class='post'", "section", "div id='content'"):
            end = box.split()[0]
            yield f"<body><header>{name}</header><{box}><!--+--><h1>A title</h1>{text}<!----></{end}></body>"
            yield f"<body><div id='header'>{name}</div><{box}><!--+--><h2>A title</h2>{text}<!----></{end}></body>"
        yield f"<body><header>{name}</header><article><header><!--+--><h1>A title of the text</h1><!----></header><!--+-->{text}<!----></article></body>"
        yield f"<body><header>{name}</header><main><article><header><!--+--><h1>Its title</h1><p>A lead</p><!----></header><!--+-->{text}<!----></article></main></body>"


PAGES += [*_noise_pages(), *_misnamed_pages(), *_bare_pages(), *_header_pages()]
PAGES += ["<!--+-->Bare text without any markup.<!---->", "<body><!--+--><p>One</p><p>Two words</p><!----></body>"]
