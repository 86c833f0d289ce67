"""Markup: subtrees and clone groups against a plain recursion over nested tuples."""

import random
from collections import defaultdict
from html.parser import HTMLParser

from twinleaf.operators import detect
from twinleaf.sources import html


class Plain(HTMLParser):
    """Nested lists [tag, attributes, children, first token, last token]; texts are [None, "", [], token, token]."""

    empty = "area base br col embed hr img input link meta source track wbr".split()

    def __init__(self, page):
        super().__init__()
        self.top = [["top", (), [], 0, 0]]
        self.n = 0
        self.feed(page)
        self.close()
        for x in self.top[1:]:
            x[4] = self.n

    def handle_starttag(self, tag, attrs):
        self.n += 1
        x = [tag, tuple(sorted(attrs, key=str)), [], self.n, self.n]
        self.top[-1][2].append(x)
        if tag not in self.empty:
            self.top.append(x)

    def handle_endtag(self, tag):
        self.n += 1
        if tag in [x[0] for x in self.top[1:]]:
            while True:
                x = self.top.pop()
                x[4] = self.n
                if x[0] == tag:
                    break

    def handle_data(self, data):
        if data.strip():
            self.n += 1
            self.top[-1][2].append([None, "", [], self.n, self.n])


def nodes(x):
    """(shape, node count, first, last) of x and all below it; texts are anonymous, attributes are nodes."""
    own, shapes, count = [], [], 1 + len(x[1])
    for c in x[2]:
        below = nodes(c)
        own += below
        shapes.append(below[-1][0])
        count += below[-1][1]
    own += [((k, v), 1, x[3], x[3]) for k, v in x[1]]
    return [*own, ((x[0], x[1], tuple(shapes)), count, x[3], x[4])]


def test_subtrees_and_groups(spark):
    rng = random.Random(2)

    def piece(depth):
        if depth == 0 or rng.random() < 0.2:
            return rng.choice(["one", " two  words ", "<br>", "<img src=a>", "&amp; x", "", "<p>open"])
        tag = rng.choice(["div", "p", "ul", "b"])
        attr = rng.choice(["", " class=x", " id='7' class='y'"])
        return f"<{tag}{attr}>" + "".join(piece(depth - 1) for _ in range(rng.randrange(4))) + rng.choice([f"</{tag}>"] * 4 + ["", "</i>"])

    some = [piece(3) for _ in range(12)]
    pages = [(i, "".join(rng.choice(some) for _ in range(rng.randrange(1, 5))), "u") for i in range(60)] + [(90, None, None), (91, "", "u")]
    df = spark.createDataFrame(pages, "page_id long, html string, url string")
    want, groups = [], defaultdict(list)
    for i, page, _ in pages:
        for x in Plain(page or "").top[0][2]:
            for shape, count, first, last in nodes(x):
                want.append((str(i), first, last, count))
                groups[shape].append((i, first, last, count))
    got = html.subtrees(df)
    assert sorted((r.file, r.start_line, r.end_line, r.node_count) for r in got.collect()) == sorted(want)
    large = {s: g for s, g in groups.items() if len(g) > 1 and g[0][3] >= 3}
    ranges = [x for g in large.values() for x in g]
    kept = [g for g in large.values() if not all(any(i == j and n > c and a <= f and z >= l for j, a, z, n in ranges) for i, f, l, c in g)]
    found = detect.as_groups(detect.detect(got, 3)).collect()
    assert sorted(sorted((int(x.file), x.start_line, x.end_line, r.node_count) for x in r.instances) for r in found) == sorted(map(sorted, kept))
