"""HTML extraction: names that hold a noise word, deep and odd containers, and the consensus of a host by brute force."""

from collections import Counter, defaultdict

import pytest

from strandframe.llm import html_extract as H

FILL = "Fill, in some words of an article that are long enough to be its text."


def text_of(page, path=None):
    return H.extract(H.blocks(page), path)


@pytest.mark.parametrize("inner, stays", [
    ("<p class='warning'>Mind the step, please.</p>", True),
    ("<div class='search-algorithm'><p>How search works, in short.</p></div>", True),
    ("<section id='legal-history'><p>Courts, and what they held.</p></section>", True),
    ("<ul class='tags'><li><a href=x>one tag</a></li><li><a href=y>two tags</a></li></ul>", False),
    ("<p class='tag'>A tag is a name, as <a href=x>linked</a> here.</p>", True),
    ("<div class='comments'><p>A reader says so.</p></div>", False),
    ("<div id='cookie-notice'>We use cookies.</div>", False),
    ("<div class='newsletterSignup'>Get our letter.</div>", False),
    ("<div class='ad-box-2'>Buy this, now.</div>", False),
    ("<aside><p>By the way, more.</p></aside>", False),
    ("<header class='header'><h2>Heading of it</h2></header>", True),
    ("<div class='related_posts'><p>More to read here.</p></div>", False),
    ("<div class='related-work'><p>Others did this, too.</p></div>", True),
    ("<div class='alert'>Service is down, today.</div>", False),
])
def test_names_inside_an_article(inner, stays):
    page = f"<body><article><h1>T</h1><p>{FILL}</p>{inner}<p>Tail, too.</p></article></body>"
    plain = text_of(f"<body><article>{inner.replace(' class=', ' data-c=').replace(' id=', ' data-i=').replace('aside', 'div')}</article></body>")
    assert text_of(page) == f"T {FILL} {plain + ' ' if stays else ''}Tail, too."


@pytest.mark.parametrize("name, stays", [("sidebar", False), ("nyt-ad-top", False), ("warning", False), ("search-algorithm", True), ("post-header", True), ("site-header", False), ("no-sidebar", True), ("tags", False), ("commentary", True), ("sharepoint", True)])
def test_names_outside_an_article(name, stays):
    page = f"<body><div class='story'><p>{FILL}</p><p>{FILL}</p><div class='{name}'><p>Some more, here.</p></div></div></body>"
    assert text_of(page) == f"{FILL} {FILL}" + " Some more, here." * stays


def test_containers_of_any_depth_and_class():
    deep = "<div class='a'>" * 3000 + f"<p>{FILL}</p>" + "</div>" * 3000
    found = H.blocks(f"<body>{deep}<div class='b'>x</div></body>")
    path = found[0].tree.path(H.best_container(found, H.container_scores(found)))
    assert path.count("/") == 3000 and text_of(deep, path) == FILL
    many = "<body><div class='z y x w-1/2 a'><p>" + f"{FILL} {FILL} {FILL}" + "</p></div><div class='z y x w-1/2 b'><p>Other.</p></div></body>"
    found = H.blocks(many)
    path = found[0].tree.path(H.best_container(found, H.container_scores(found)))
    assert path == "body/div.a.w-#|#.x.y.z" and text_of(many, path) == f"{FILL} {FILL} {FILL}"


def test_very_deep_pages_take_linear_time():
    H.extract(H.blocks("<div>a, b." * 50_000), None)


def _score(found, path):
    """The definition of a container's score, by its own blocks and those of all paths below it."""
    total = 0.0
    for b in found:
        steps, top = b.tree.path(b.node).split("/"), path.split("/")
        if steps[: len(top)] == top:
            gain = (len(b.text) - b.linked) * (1.0 if b.tag in ("p", "pre", "blockquote", "li", "td", "h1", "h2", "h3", "h4") else 0.6) - 2.0 * b.linked + 10.0 * (b.text.count(",") + b.text.count("."))
            total += gain * 0.9 ** (len(steps) - len(top))
    last = path.split("/")[-1]
    return total * (1.6 if last.startswith(("article", "main")) else 1.3 if H._MAIN_WORD.search(last.partition('.')[2]) else 1.0)


def _paths(found):
    out = set()
    for b in found:
        steps = b.tree.path(b.node).split("/")
        out |= {"/".join(steps[:k]) for k in range(1, len(steps) + 1)} - {""}
    return out


def test_query_against_brute_force(spark):
    """op7 over the whole smallest table: scores, votes and extraction once more, page by page."""
    from strandframe.llm import queries

    sf = "/root/testdata/sf0.001"
    pages = spark.read.parquet(f"{sf}/pages.parquet").collect()
    host = lambda u: (u or "").split("://")[1].split("/")[0].split("@")[-1].split(":")[0].lower() if "://" in (u or "") else ""
    votes = defaultdict(Counter)
    scores = defaultdict(float)
    for p in pages:
        found = H.blocks(p.html or "")
        if paths := _paths(found):
            best = min(paths, key=lambda x: (-round(_score(found, x), 6), x.split("/")))
            votes[host(p.url)][best] += 1
            scores[host(p.url), best] += _score(found, best)
    want = Counter()
    for p in pages:
        found = H.blocks(p.html or "")
        held = votes[host(p.url)]
        path = min(held, key=lambda x: (-held[x], -round(scores[host(p.url), x]), x)) if held else None
        inside = [b.text for b in found if path and (b.tree.path(b.node) + "/").startswith(path + "/")]
        if not inside and (paths := _paths(found)):
            own = min(paths, key=lambda x: (-round(_score(found, x), 6), x.split("/")))
            inside = [b.text for b in found if (b.tree.path(b.node) + "/").startswith(own + "/")]
        elif not inside:
            inside = [b.text for b in found]
        text = " ".join(inside)
        want[p.page_id, p.url, text, len(text), path] += 1
    assert Counter(tuple(r) for r in queries.op7_html(spark, sf).collect()) == want


def test_awkward_pages(spark):
    """Null columns, repeated and very long pages, clashing names."""
    page = f"<body><div class='x'><p>{FILL}</p></div><div class='y'>z</div></body>"
    rows = [(1, "http://h.x/a", page), (1, "http://h.x/a", page), (None, None, page), (2, None, None), (None, "http://h.x/b", ""), (3, "http://h.x/c", "<p>" + "long text, " * 200_000)]
    docs = spark.createDataFrame(rows, "page_id long, url string, html string")
    for c in ("host", "path", "votes", "score", "text"):
        docs = docs.withColumn(c, docs.url)
    got = Counter((r.page_id, r.url, r.text) for r in H.extract_pages(docs).collect())
    assert got == {(1, "http://h.x/a", FILL): 2, (None, None, FILL): 1, (2, None, ""): 1, (None, "http://h.x/b", ""): 1, (3, "http://h.x/c", ("long text, " * 200_000).strip()): 1}
