import os

import pytest

from twinleaf import cli
from twinleaf.config import AnonymizationSettings
from twinleaf.operators import detect
from twinleaf.sources import php, python_code, trees

from sources import APART, LEDGERS, NESTED, PARTIAL, written

DEFAULT = AnonymizationSettings()


def found(spark, tmp_path, sources, least, flags=DEFAULT):
    groups = cli.find(spark, written(tmp_path, sources), least, flags, php.parse, "php")
    return [(g.node_count, [(os.path.basename(i.file), i.start, i.end) for i in g.instances]) for g in groups]


def twice(a, b, ranges):
    return [(n, [(a, s, e), (b, s, e)]) for n, s, e in ranges]


def test_nested_groups(spark, tmp_path):
    assert found(spark, tmp_path, NESTED, 3) == twice("A1.php", "A2.php", [(29, 4, 10), (4, 3, 3)])
    files = spark.createDataFrame([(n, k, t) for k, (n, t) in enumerate(sorted(NESTED.items()))], "file string, file_ord long, text string")
    assert detect.hash_groups(trees.extract(files, php.parse, DEFAULT, 3)).count() == 15


def test_partial_groups(spark, tmp_path):
    assert found(spark, tmp_path, PARTIAL, 3) == [
        *twice("P1.php", "P2.php", [(25, 2, 10)]),
        (15, [("P1.php", 4, 8), ("P2.php", 4, 8), ("Q.php", 3, 7)]),
        (4, [("P1.php", 3, 3), ("P2.php", 3, 3), ("Q.php", 2, 2)]),
    ]


def test_groups_apart_and_ties(spark, tmp_path):
    assert found(spark, tmp_path, APART, 3) == twice("T1.php", "T2.php", [(16, 11, 13), (6, 3, 3), (6, 4, 4), (6, 5, 5), (4, 6, 6), (4, 10, 10)])


def test_classes(spark, tmp_path):
    assert found(spark, tmp_path, LEDGERS, 10) == twice("L1.php", "L2.php", [(27, 36, 42), (11, 14, 18), (11, 25, 29)])
    assert found(spark, tmp_path, LEDGERS, 9999) == []


def test_different_code_has_no_clones(spark, tmp_path):
    assert found(spark, tmp_path, {"a.php": "<?php function f(){return 2;}", "b.php": "<?php class G{public $p;}"}, 5) == []


def digest(code, **flags):
    return [d for *_, d in trees.rows(php.parse("<?php " + code), AnonymizationSettings(**{"variables": False, **flags}))][-1]


@pytest.mark.parametrize(
    "a,b,flags,equal",
    [
        ("function f($in){$r = $in; return $r;}", "function f($v){$o = $v; return $o;}", ["variables"], True),
        ("$a = 1;", "$b = 1;", [], False),
        ("$a = 'one';", '$b = "two";', ["variables", "literals"], True),
        ("$a = 42;", "$a = 0x1f;", ["variables", "literals"], True),
        ("$a = 3.5;", "$a = 1e3;", ["variables", "literals"], True),
        ("$a = 'one';", "$a = 'two';", ["variables"], False),
        ("f($x);", "g($x);", ["variables", "names"], True),
        ("f($x);", "\\g($x);", ["variables", "names"], True),
        ("f($x);", "g($x);", ["variables"], False),
        ("$o->f();", "$o->g();", ["variables", "identifiers"], True),
        ("$o->f();", "$o->g();", ["variables"], False),
        ("class A extends B {public $p = 1; function m(){return X::c('s');}}", "class C extends D {public $q = 2; function n(){return Y::d('t');}}", ["variables", "literals", "names", "identifiers"], True),
        ("$a + $a;", "$a + $b;", ["variables"], True),
        ("${'a'} + 1;", "$a + 1;", ["variables"], True),
        ("$$a;", "$a;", ["variables"], False),
        ("'a';", '"a";', [], True),
        ("12; // x", "0b1100 /* y */;", [], True),
        ("if ($a) { b(); }", "if ($a): b(); endif;", [], True),
        ("[$a, $b];", "array($a, $b);", [], True),
        ("$a . $b;", "$a + $b;", ["variables"], False),
    ],
)
def test_normalisation(a, b, flags, equal):
    on = {f: True for f in flags}
    assert (digest(a, **on) == digest(b, **on)) == equal


def test_digests_equal_exactly_when_positional_numbering_does():
    """Numbering every anonymised value by position within each subtree gives the same classes."""
    import random

    rng = random.Random(2)

    def expr(depth):
        k = rng.randrange(8 if depth else 3)
        if k < 2:
            return f"${rng.choice('abc')}"
        if k == 2:
            return rng.choice(["1", "'s'", "X"])
        if k == 3:
            return f"${{{expr(depth - 1)}}}"
        if k == 4:
            return f"f({expr(depth - 1)}, {expr(depth - 1)})"
        return f"({expr(depth - 1)} {rng.choice('+-')} {expr(depth - 1)})"

    def positional(node):
        count = [0]

        def show(n):
            if isinstance(n, list):
                return "[" + ",".join(show(x) for x in n if x is not None) + "]"
            if not isinstance(n, trees.Node):
                return repr(n)
            parts = []
            if n.flag == "variables":
                for _, v in n.parts:
                    show(v)
                mine = count[0]
                count[0] += 1
                return f"{n.kind}|V{mine}"
            for name, v in n.parts:
                parts.append(f"{name}:{show(v)}")
            return n.kind + "|" + "|".join(parts)

        return show(node)

    ours, theirs = {}, {}
    for _ in range(600):
        for node, _, d in trees.walk(php.parse(f"<?php {expr(4)};"), DEFAULT):
            p = positional(node)
            assert ours.setdefault(d, p) == p and theirs.setdefault(p, d) == d


@pytest.mark.parametrize(
    "code",
    [
        "namespace A\\B; use C\\{D, E as F}; use function g; const X = 1, Y = 2;",
        "abstract class A extends B implements C, D { use T, U { T::a insteadof U; b as protected c; } const int K = 1; private ?int $x = null; final protected static function f(int|string ...$a): ?static { return new static(...$a); } abstract function g(); }",
        "enum S: string implements I { case A = 'a'; case B = 'b'; public function l(): string { return match(true) { $this === self::A, default => 'x' }; } }",
        "#[Attr(1, name: 'x')] function f(#[In] readonly int $a = 5, &$b = [1, 2]) : void {}",
        "$f = fn($x) => $x ** 2; $g = static function () use (&$f): int { yield $k => $v; yield from h(); return 1; };",
        "switch ($a) { case 1: case 2: b(); break; default: c(); }",
        "try { a(); } catch (A | B $e) { throw $e; } finally { c(); }",
        "for ($i = 0, $j = 1; $i < 5; $i++, --$j): echo $i, $j; endfor; while ($a): endwhile; do { $a--; } while ($a);",
        "echo <<<X\n a {$b->c['d']} ${e} $f[0] $g->h \\n\n X;\n$n = <<<'Y'\nraw $x\nY;",
        "$a ??= $b ?: $c ?? $d; [$x, , [$y]] = $z; list('k' => $v) = $w; $o?->p?->q(); $o::$s; A::{$m}(); ($f)(1)(2); new class(1) extends B { public $p; };",
        "if ($a) { } elseif ($b) { } else if ($c) { } else { } ?>\n<b>html</b>\n<?= $x ?> text",
        "declare(strict_types=1); goto end; end: static $n = 1; global $g; unset($a, $b); isset($a['b']); exit; print 'x'; @f(); `ls $d`; (int) $x; clone $y; !$a instanceof B; f(...);",
    ],
)
def test_syntax(code):
    assert php.parse("<?php " + code)


@pytest.mark.parametrize("code", ["function {", "$a = ;", "class { }", "if ($a {", "'open", "$a = <<<X\nno end", "f(;", "\x01"])
def test_bad_syntax_fails(code):
    with pytest.raises(trees.ParseError, match="Parse error"):
        php.parse("<?php " + code)


def test_errors_name_the_file_or_are_skipped(spark):
    files = spark.createDataFrame([("good.php", 0, "<?php f($x);"), ("bad.php", 1, "<?php f("), ("none.php", 2, None), ("empty.php", 3, "")], "file string, file_ord long, text string")
    with pytest.raises(Exception, match="bad.php: Parse error"):
        trees.extract(files, php.parse, DEFAULT).collect()
    assert {r.file for r in trees.extract(files, php.parse, DEFAULT, on_error="skip").collect()} == {"good.php"}
    with pytest.raises(ValueError):
        trees.extract(files, php.parse, DEFAULT, on_error="x")


def test_python_front_end():
    a = python_code.parse("def f(x):\n    return x + 1\n")
    b = python_code.parse("def f(y):\n    return y + 1\n")
    assert [r[-1] for r in trees.rows(a, DEFAULT)] == [r[-1] for r in trees.rows(b, DEFAULT)]
    with pytest.raises(trees.ParseError):
        python_code.parse("def")
