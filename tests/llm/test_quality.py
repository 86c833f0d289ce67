import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa

from twinleaf.llm import quality


def base_by_hand(t):
    t = t or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    seen, dup = set(), 0
    for line in t.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    windows = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    covered = {j for i in range(len(w) - 7) if windows[tuple(w[i : i + 8])] > 1 for j in range(i, i + 8)}
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), dup, len(covered)


def texts():
    rng = random.Random(8)
    out = [None, "", " \n\t ", "a", "#é<>|", "x\n\nx\n x\nx\r\nx\r", "\n", "one two three four five six seven eight " * 3, "a\nb\n" * 9, "q " * 30]
    for _ in range(60):
        w = [rng.choice(["ab", "é", "c,", "#x", "10%", "\n", "zz\n"]) for _ in range(rng.randrange(60))]
        out.append(" ".join(w + w[: rng.choice([0, 0, 9, 30])]))
    return out


def test_base_counts():
    ts = texts()
    got = quality.base(pa.array(ts, pa.string()))
    assert list(zip(*(got[c].tolist() for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")))) == [base_by_hand(t) for t in ts]


def test_base_counts_rest_on_bytes(monkeypatch):
    text = "a"
    for _ in range(10):
        text += text.translate(str.maketrans("ab", "ba"))
    other = text.translate(str.maketrans("ab", "ba"))
    ts = [*texts(), f"{text}\n{other}", " ".join([text, other] * 8 + [text] * 3), "x " * 300_000 + "\n".join(f"word{k} {k % 1000}" for k in range(150_000))]
    want = [base_by_hand(t) for t in ts]
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")

    def got():
        out = quality.base(pa.array(ts, pa.string()))
        return list(zip(*(out[c].tolist() for c in names)))

    assert got() == want
    monkeypatch.setattr(quality.common.Ranges, "__call__", lambda self, start, end: np.zeros(len(start), dtype=np.uint64))
    assert got() == want


def verdicts_by_hand(rows):
    """kept of (id, text, lang) rows, by plain dictionaries and lists."""
    out, langs = {}, {}
    for i, t, lang in rows:
        langs.setdefault(lang, []).append((i, t or ""))
    for own in langs.values():
        p = model_by_hand([t for _, t in own], quality.ORDER)
        memo, places = {}, {}
        for i, t in own:
            n, _, _, _, again = base_by_hand(t)
            s = "\2" * (quality.ORDER - 1) + t.lower()
            total = 0.0
            for k in range(len(t)):
                g = s[k : k + quality.ORDER]
                if g not in memo:
                    memo[g] = math.log(p(g))
                total += memo[g]
            failed = n < 20 or 100 * again > 30 * n
            places[i] = failed, -total / max(len(t), 1), int(math.log2(max(len(t), 1))), t
        votes = {}
        for failed, x, octave, t in places.values():
            if not failed:
                votes.setdefault(octave, {})[t] = round(x * 500)
        for i, (failed, x, octave, _) in places.items():
            if failed:
                out[i] = False
                continue
            others = sum(len(v) * 4.0 ** -abs(o - octave) for o, v in votes.items() if o != octave)
            weighted = sorted((b, 1.0 if o == octave else 4.0 ** -abs(o - octave) * 100 / (100 + others)) for o, v in votes.items() for b in v.values())
            whole, upto, cuts = sum(w for _, w in weighted), 0.0, []
            for share in (0.25, 0.5, 0.75):
                upto = 0.0
                for b, w in weighted:
                    upto += w
                    if upto >= share * whole - 1e-9:
                        cuts.append(b / 500)
                        break
            spread = max((cuts[2] - cuts[0]) / 1.349, 0.002)
            out[i] = cuts[1] - 4 * spread <= x <= cuts[1] + 6 * spread
    return out


def test_verdicts_by_hand(spark):
    rng = random.Random(11)
    syllables = ["the", "on", "ing ", " er", "a ", "ti", "É", "sh"]
    rows = [(i, "".join(rng.choice(syllables) for _ in range(rng.choice([60, 90, 200, 700]))) + " x y" * 12, rng.choice(["en", "de", None])) for i in range(150)]
    rows += [(200 + i, " ".join("".join(rng.choice("qxzwvkj#@!0123456789") for _ in range(9)) for _ in range(30)), "en") for i in range(4)]
    rows += [(300 + i, rows[i][1], rows[i][2]) for i in range(20)] + [(400, None, "en"), (401, "", None), (402, "the on ing " * 40, "de")]
    got = {r.doc_id: r.kept for r in quality.quality(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    want = verdicts_by_hand(rows)
    assert got == want and 0 < sum(want.values()) < len(want)
    units = quality.grams(pa.array(["a😀"]))[0]
    assert len(units) == 3 and units[1] & np.uint64(0xFFFF) == 0xD83D


def model_by_hand(ts, n):
    """A plain Kneser-Ney model with dictionaries; strings of characters."""
    top = Counter()
    for t in ts:
        s = "\2" * (n - 1) + t.lower()
        top.update(s[i : i + n] for i in range(len(t)))
    levels = {n: top}
    for k in range(n - 1, 0, -1):
        levels[k] = Counter(g[1:] for g in levels[k + 1])
    parts = {}
    for k, counts in levels.items():
        n1, n2, n3, n4 = (max(sum(c == j for c in counts.values()), 1) for j in (1, 2, 3, 4))
        y = n1 / (n1 + 2 * n2)
        d = [min(max(x, 0.05), top) for x, top in ((1 - 2 * y * n2 / n1, 0.95), (2 - 3 * y * n3 / n2, 1.9), (3 - 4 * y * n4 / n3, 2.85))]
        total, left = Counter(), Counter()
        for g, c in counts.items():
            total[g[:-1]] += c
            left[g[:-1]] += d[min(c, 3) - 1]
        parts[k] = counts, d, total, left

    def p(g):
        if not g:
            return 1 / (len(levels[1]) + 1)
        counts, d, total, left = parts[len(g)]
        if not total[g[:-1]]:
            return p(g[1:])
        c = counts.get(g, 0)
        return (c - d[min(c, 3) - 1] if c else 0) / total[g[:-1]] + left[g[:-1]] / total[g[:-1]] * p(g[1:])

    return p


def test_perplexity_and_bands_by_hand(spark):
    rng = random.Random(1)
    syllables = ["the", "on", "ing ", " er", "a ", "ti", "É", "sh"]
    rows = [(i, "".join(rng.choice(syllables) for _ in range(200)) + " x y" * 12, rng.choice(["en", "de", None])) for i in range(60)]
    rows.append((99, " ".join("".join(rng.choice("qxzwvkj#@!0123456789") for _ in range(9)) for _ in range(40)), "en"))
    rows += [(98, None, "en"), (97, "", None)]
    df = spark.createDataFrame([(*r, "c") for r in rows], "doc_id long, text string, lang string, kept string")
    got = {r.doc_id: r for r in quality.quality(df).collect()}
    for lang in ("en", "de", None):
        own = [(i, t or "") for i, t, x in rows if x == lang]
        p = model_by_hand([t for _, t in own], quality.ORDER)
        for i, t in own[:8] + own[-2:]:
            s = "\2" * (quality.ORDER - 1) + t.lower()
            want = -sum(math.log(p(s[k : k + quality.ORDER])) for k in range(len(t))) / max(len(t), 1)
            assert abs(got[i].log_perplexity - want) < 1e-9
    assert not got[99].base_failed and not got[99].kept
    assert sum(r.kept for r in got.values()) == 60 and got[98].base_failed and got[97].n_words == 0


def test_unseen_strings_and_large_tables():
    rng = np.random.default_rng(0)
    keys = np.unique(rng.integers(0, 1 << 62, 5000, dtype=np.uint64))
    table = quality.Table(keys, np.arange(len(keys)), np.ones(len(keys)))
    value, there = table.get(np.concatenate([keys, keys + np.uint64(1 << 63)]))
    assert (value[: len(keys)] == np.arange(len(keys))).all() and there[: len(keys)].all() and not there[len(keys) :].any()


def test_empty_table(spark):
    assert quality.quality(spark.createDataFrame([], "doc_id long, text string, lang string")).count() == 0


def many_strings(spark):
    rng = random.Random(3)
    rows = [(i % 70, " ".join("".join(chr(0x4E00 + rng.randrange(300)) for _ in range(4)) for _ in range(60)), rng.choice(["zh", "ja"])) for i in range(80)]
    return rows, spark.createDataFrame(rows + rows[:3], "doc_id long, text string, lang string").repartition(3)


def test_more_strings_than_one_pass_holds_all_count(spark, monkeypatch):
    rows, df = many_strings(spark)
    order = ["doc_id", "n_words", "log_perplexity"]
    once = quality.quality(df).orderBy(*order).collect()
    # 80 texts have over 20,000 strings
    monkeypatch.setattr(quality, "PASS_ENTRIES", 5000, raising=False)
    monkeypatch.setattr(quality, "MODEL_ENTRIES", 5000, raising=False)
    parts = quality.quality(df).orderBy(*order).collect()
    assert len(once) == len(parts) == 83
    assert all(abs(a.log_perplexity - b.log_perplexity) < 1e-9 and a.kept == b.kept for a, b in zip(once, parts, strict=True))
    own = [t for _, t, x in rows + rows[:3] if x == "zh"]
    p = model_by_hand(own, quality.ORDER)
    s = "\2" * (quality.ORDER - 1) + own[0]
    want = -sum(math.log(p(s[k : k + quality.ORDER])) for k in range(len(own[0]))) / len(own[0])
    assert any(abs(r.log_perplexity - want) < 1e-9 for r in parts)


def prose(rng, n):
    syllables = ["the", "on", "ing ", " er", "a ", "ti", "É", "sh"]
    return "".join(rng.choice(syllables) for _ in range(n)) + " x y" * 12


def test_copies_have_one_vote_in_the_bands(spark):
    rng = random.Random(5)
    rows = [(i, prose(rng, 300), "en") for i in range(150)]
    df = spark.createDataFrame(rows + [(1000 + i, rows[0][1], "en") for i in range(600)], "doc_id long, text string, lang string").repartition(3)
    got = quality.quality(df).collect()
    assert len(got) == 750 and sum(r.kept for r in got if 0 < r.doc_id < 150) >= 145


def test_bands_do_not_switch_at_a_number_of_documents():
    long, other = (np.arange(990, 1010), np.full(20, 5.0)), (np.arange(1100, 1300), np.full(200, 10.0))
    edges = []
    for n in (98, 99, 100, 101):
        own = (long[0], long[1] * n / 100)
        edges.append(quality.band({8: other, 11: own}, 11))
    assert max(abs(a - b) for x, y in zip(edges, edges[1:]) for a, b in zip(x, y)) <= 6 * 5 / 500
    assert quality.band({11: long}, 11) == quality.band({11: long, 8: (np.zeros(0, dtype=int), np.zeros(0))}, 11)


def test_every_language_has_a_model_of_its_own(spark):
    rng = random.Random(4)
    rows = [(i, prose(rng, 40) + f" {i}", f"l{i % 70}") for i in range(140)]
    got = {r.doc_id: r for r in quality.quality(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    for lang in range(70):
        own = [(i, t) for i, t, x in rows if x == f"l{lang}"]
        p = model_by_hand([t for _, t in own], quality.ORDER)
        for i, t in own:
            s = "\2" * (quality.ORDER - 1) + t.lower()
            want = -sum(math.log(p(s[k : k + quality.ORDER])) for k in range(len(t))) / len(t)
            assert abs(got[i].log_perplexity - want) < 1e-9
