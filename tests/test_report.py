import random
import re

import pytest

from twinleaf.highlight import BACKGROUND, DIFF, RESET, Highlighter
from twinleaf.operators.diff import common_part, instance_ranges, split_differences
from twinleaf.report_text import Group, Instance, TextReporter, dedent, rows

PLAIN = Highlighter(False)


@pytest.mark.parametrize(
    "instances,want",
    [
        ([["$k = 5;", "go();"]] * 2, [[[], []]] * 2),
        ([["unlock $n;"], ["load $n;"]], [[[(0, 6)]], [[(0, 4)]]]),
        ([["$q = sum();"], ["$q = gap();"]], [[[(5, 8)]], [[(5, 8)]]]),
        ([["$amount = $c * $d;"], ["$amount = $e * $f;"]], [[[(11, 12), (16, 17)]]] * 2),
        ([["$k = 5;"], ["$k = 5222;"]], [[[]], [[(6, 9)]]]),
        ([["only"]], []),
        ([], []),
        ([["$q = sum();"], ["$q = gap();"], ["$q = hit();"]], [[[(5, 8)]]] * 3),
        ([["same", "yields $c - $d;"], ["same", "yields $e - $f;"]], [[[], [(8, 9), (13, 14)]]] * 2),
        ([["if ($sum->toA() || $sum->toB()) {"], ["if ($gap->toA() || $gap->toB()) {"]], [[[(5, 8), (20, 23)]]] * 2),
        ([["go();", "", "end();"], ["go();", "end();"]], [[[], [], []], [[], []]]),
        ([["$q = sum();", "", "end();"], ["$q = gap();", "end();"]], [[[(5, 8)], [], []], [[(5, 8)], []]]),
        ([["a", "b"], ["a"]], [[[], []], [[]]]),
    ],
)
def test_ranges(instances, want):
    assert instance_ranges(instances) == want


def test_ranges_are_bytes_and_leave_equal_parts():
    assert split_differences(["é = foo".encode(), "é = bar".encode()]) == [[(5, 8)], [(5, 8)]]
    rng = random.Random(3)
    for _ in range(300):
        texts = [bytes(rng.choice(b"abc(") for _ in range(rng.randrange(25))) for _ in range(rng.choice([2, 3]))]
        rest = set()
        for t, ranges in zip(texts, split_differences(texts)):
            assert all(a < b for a, b in ranges) and ranges == sorted(ranges)
            rest.add(b"".join(t[a:b] for a, b in zip([0] + [b for _, b in ranges], [a for a, _ in ranges] + [len(t)])))
        assert len(rest) == 1


def test_common_part_by_brute_force():
    rng = random.Random(4)
    for _ in range(300):
        parts = [bytes(rng.choice(b"ab") for _ in range(rng.randrange(14))) for _ in range(3)]
        s = min(parts, key=len)
        best = next((s[i : i + n] for n in range(len(s), 2, -1) for i in range(len(s) - n + 1) if all(s[i : i + n] in p for p in parts)), b"")
        assert common_part(parts) == best


def report(groups, texts, **more):
    out = []
    TextReporter(out.append, more.pop("paint", PLAIN), texts.__getitem__, "/w", **more).report(groups, 1.23)
    return "\n".join(out)


def test_no_groups():
    assert report([], {}) == "\n No code clones detected, took 1.23s \n"


def group(*instances, n=7):
    return Group(n, tuple(Instance(*i) for i in instances))


def test_unified_rows_and_variants():
    texts = {"/w/a": "\n" * 9 + "f {\n  $x = 1;\n  $y = 2;\n", "/w/b": "\n" * 19 + "f {\n  $a = 1;\n  $b = 2;\n"}
    text = report([group(("/w/a", 10, 12), ("/w/b", 20, 22))], texts)
    assert "Clone #1  7 nodes · 2 instances" in text and "exact match" not in text and "a:10-12" in text
    assert re.search(r" 10  f \{\n +11    \$x = 1;\n +21    \$a = 1;\n +12    \$y = 2;\n +22    \$b = 2;", text)
    assert " 20  " not in text and "✖ 1 clone groups found (1.23s)" in text


def test_exact_match_after_dedent_and_blank_lines():
    texts = {"/w/a": "    f();\n    g();", "/w/b": "\t\t\t\tf();\n\t\t\t\tg();", "/w/c": "f();\ng();"}
    text = report([group(("/w/a", 1, 2), ("/w/b", 1, 2), ("/w/c", 1, 2))], texts)
    assert "exact match" in text and text.count("f();") == 1
    assert dedent(["  a", "", "   b", "\t"]) == ["a", "", " b", ""]


def test_equal_variants_share_a_row():
    texts = {"/w/a": "x(1);", "/w/b": "\nx(2);", "/w/c": "\n" * 9 + "x(1);"}
    i = [Instance("/w/a", 1, 1), Instance("/w/b", 2, 2), Instance("/w/c", 10, 10)]
    found = rows(i, [["x(1);"], ["x(2);"], ["x(1);"]])
    assert [([n for _, n in r.line_nums], r.text, r.alternative) for r in found] == [([1, 10], "x(1);", False), ([2], "x(2);", True)]
    assert "1, 10  x(1);" in report([Group(3, tuple(i))], texts)


def test_fallback_prints_each_instance():
    texts = {"/w/a": "a\nb\nc", "/w/b": "\na\nb"}
    text = report([group(("/w/a", 1, 3), ("/w/b", 2, 3))], texts)
    assert len(re.findall(r"\d  a\n", text)) == 2 and re.search(r"3  b", text)


def test_patch_labels_and_order():
    texts = {"/w/a": "a", "/w/b": "a"}
    one = [Group(3, (Instance("/w/a", 1, 1), Instance("/w/b", 1, 1, True)))]
    text = report(one, texts, patch=True)
    assert "1 new ↔ 1 existing" in text and text.index("b:1-1") < text.index("a:1-1")
    assert "intra-MR duplication" in report([Group(3, (Instance("/w/a", 1, 1, True),) * 2)], texts, patch=True)


def test_colours():
    paint = Highlighter(True)
    line = "return $x + foo('a', 12); // end"
    text = paint.highlight(line)
    assert "\x1b[94mreturn" in text and "\x1b[36m$x" in text and "\x1b[32m'a'" in text and "\x1b[33m12" in text and "\x1b[90m // end" in text
    assert re.sub(r"\x1b\[[0-9;]*m", "", text) == line and PLAIN.highlight(line) == line
    marked = paint.highlight_with_diffs(line, [(8, 9)])
    assert DIFF + "\x1b[36m$x" in marked and re.sub(r"\x1b\[[0-9;]*m", "", marked) == line
    assert paint.background(text).count(BACKGROUND) == 1 + text.count(RESET) and PLAIN.background("x") == "x"
    assert "\x1b[35mint" in paint.highlight("function f(int $a): Foo {}") and "\x1b[35mFoo" in paint.highlight("function f(int $a): Foo {}")
    assert paint.bold("x") == "\x1b[1mx\x1b[0m" and paint.dim("") == "" and PLAIN.line_number("3") == "3"
    linked = TextReporter(print, paint, str, "/w", "e://{relFile}?{file}:{line}").link("t", "/w/a.php", 3)
    assert linked == "\x1b]8;;e://a.php?/w/a.php:3\x1b\\t\x1b]8;;\x1b\\"
