import io
import json
import os

import pytest

from twinleaf import cli
from twinleaf.config import CloneConfig, UserError, parse_min_node_count, resolve
from twinleaf.sources import patch, scan

from sources import LEDGERS, written


@pytest.fixture
def work(tmp_path):
    (tmp_path / "src").mkdir()
    (tmp_path / ".git").mkdir()
    written(tmp_path / "src", LEDGERS)
    (tmp_path / "src" / "notes.txt").write_text("not code")
    return tmp_path


def run(spark, folder, *args):
    out, err = io.StringIO(), io.StringIO()
    code = cli.run([*args, "--cache-dir", str(folder / "cache")], spark, out, err, str(folder))
    return code, out.getvalue(), err.getvalue()


def test_clones_limits_and_cache(spark, work):
    code, out, err = run(spark, work, "-m", "10")
    assert code == 1 and "3 clone groups found" in out and "Scanning: ./src" in err and "Limit: 10 nodes" in err
    assert run(spark, work, "src", "-m", "10")[1].split("(")[0] == out.split("(")[0]  # now from the cache
    assert run(spark, work, "-m", "9999")[:1] == (0,) and "No code clones" in run(spark, work, "detect", "-m", "9999")[1]
    (work / "src" / "L2.php").write_text("<?php f();")
    assert run(spark, work, "-m", "10")[0] == 0


@pytest.mark.parametrize("text", ["0", "-1", "x", "1.5", "", "05"])
def test_bad_limits(spark, work, text):
    code, _, err = run(spark, work, f"--min-node-count={text}")
    assert code == 2 and "positive integer" in err
    with pytest.raises(UserError):
        parse_min_node_count(text)


def test_errors(spark, work):
    assert "Path not found" in run(spark, work, "gone")[2]
    (work / "empty").mkdir()
    assert "No .php files" in run(spark, work, "empty")[2]
    assert "Config file not found" in run(spark, work, "-c", "gone.toml")[2]


def test_config_excludes_and_overrides(spark, work):
    (work / "twinleaf.json").write_text(json.dumps({"min_node_count": 10, "paths": ["src"], "exclude_paths": ["src/L2.php"]}))
    code, out, err = run(spark, work)
    assert code == 0 and "(auto-detected)" in err and "Excluding: ./src/L2.php" in err
    (work / "own.toml").write_text('min_node_count = 5000\nexclude_paths = ["cache.php"]\n')
    (work / "cache.php").write_text("<?php f();")
    code, out, err = run(spark, work, "src", "-c", "own.toml", "-m", "10")
    assert code == 1 and "Warning: excluded path" in err


def test_patch_modes(spark, work):
    text = LEDGERS["L2.php"].split("\n")
    lines = "".join(f"+{x}\n" for x in text[35:42])
    (work / "p.diff").write_text(f"--- a/src/L2.php\n+++ b/src/L2.php\n@@ -35,0 +36,7 @@\n{lines}")
    code, out, err = run(spark, work, "-m", "10", "--patch", "p.diff")
    assert code == 1 and "1 clone groups found" in out and "1 new ↔ 1 existing" in out and out.index("L2.php:36-42") < out.index("L1.php:36-42")
    code, out, err = run(spark, work, "src", "-m", "50", "--patch", "p.diff")
    assert code == 0


def test_config_values():
    c = CloneConfig()
    assert c.min_node_count is None and c.anonymization.variables and not c.anonymization.names
    assert c.with_min_node_count(3).with_path("a").with_path("b").with_exclude_path("c").with_editor_url("u").with_anonymization(names=True).paths == ("a", "b")
    for bad in (0, -1, True, "3"):
        with pytest.raises(ValueError):
            c.with_min_node_count(bad)


@pytest.mark.parametrize("name,text", [("c.txt", ""), ("c.json", "{"), ("c.json", "[]"), ("c.json", '{"min_node_count": 0}'), ("c.toml", "nothing = 1"), ("c.json", '{"anonymize": {"x": true}}')])
def test_bad_configs(tmp_path, name, text):
    (tmp_path / name).write_text(text)
    with pytest.raises(UserError):
        resolve(str(tmp_path), name)
    assert resolve(str(tmp_path)).path is None


def test_scan_is_sorted_and_without_repeats(spark, work):
    listed = scan.list_files([str(work / "src"), str(work / "src" / ".." / "src" / "L1.php")])
    assert [os.path.basename(f) for f in listed] == ["L1.php", "L2.php"]
    rows = scan.read_files(spark, [str(work / "src")], [str(work / "src" / "L2.php")]).collect()
    assert [os.path.basename(r.file) for r in rows] == ["L1.php"] and rows[0].text == LEDGERS["L1.php"]


DIFF = "diff --git a/s/S.php b/s/S.php\n--- a/s/S.php\n+++ b/s/S.php\n@@ -1,1 +1,4 @@\n <?php\n+two\n+three\n+four\n"


@pytest.mark.parametrize(
    "name,text,disk,error",
    [
        ("a.txt", DIFF, None, "expecting .patch or .diff extension"),
        ("a.patch", DIFF.replace("b/s/S.php", "s/S.php"), "x", "unsupported prefix"),
        ("a.patch", DIFF, None, "does not exist on disk"),
        ("a.patch", DIFF, "<?php\nother\n", "does not match actual content"),
        ("a.patch", DIFF, "<?php", "such line does not exist"),
    ],
)
def test_patch_errors(tmp_path, name, text, disk, error):
    (tmp_path / ".git").write_text("gitdir: x")
    (tmp_path / "s").mkdir()
    (tmp_path / name).write_text(text)
    if disk is not None:
        (tmp_path / "s" / "S.php").write_text(disk)
    with pytest.raises(UserError, match=error):
        patch.parse(str(tmp_path / name), str(tmp_path))


def test_patches(spark, tmp_path):
    p = tmp_path / "a.patch"
    with pytest.raises(UserError, match="not found"):
        patch.parse(str(p), str(tmp_path))
    p.write_text(DIFF)
    if patch.git_root(str(tmp_path)) is None:
        with pytest.raises(UserError, match="git repository"):
            patch.parse(str(p), str(tmp_path))
    (tmp_path / ".git").mkdir()
    (tmp_path / "s").mkdir()
    (tmp_path / "s" / "S.php").write_text("<?php\ntwo\nthree\nfour\n")
    changed = patch.parse(str(p), str(tmp_path))
    file = os.path.realpath(tmp_path / "s" / "S.php")
    assert changed == {file: {2, 3, 4}}
    assert patch.contains_range(changed, file, 2, 4) and not patch.contains_range(changed, file, 1, 1) and not patch.contains_range(changed, file, 1, 4) and not patch.contains_range(changed, "other", 1, 1)
    assert patch.as_table(spark, changed).count() == 3
    p.write_text("--- a/g.php\n+++ /dev/null\n@@ -1,2 +0,0 @@\n-<?php\n-x\n")
    assert patch.parse(str(p), str(tmp_path)) == {}
