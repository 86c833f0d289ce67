"""Secret scans with a random forest against false positives (operator 6), in DataFrame functions only.

One regular expression finds candidates: values assigned to telling names, well-known key formats and long tokens with digits.
A random forest, trained from labelled findings on a candidate's length, character
transitions, dictionary coverage, path-like parts and neighbouring words, then decides which are secrets. The dictionary
is the corpus's own: the words that most documents have, in whatever languages. The
trained trees become SQL expressions, so a document is scanned within its own row, without a shuffle.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

TREES, DEPTH = 20, 6
#: Words in the dictionary, the bound on what goes to the driver, and their least letters.
WORDS, LETTERS = 4000, 4
MARK = "[SECRET]"
# Names and formats that secrets are known by.
NAMES = r"pass(?:word|wd|phrase)?|pwd|secret|token|api[_-]?key|access[_-]?key|private[_-]?key|credential|auth"
FORMATS = r"(?:AKIA|ASIA)[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{20,}+|xox[abprs]-[A-Za-z0-9-]{10,}+|sk_(?:live|test)_[0-9A-Za-z]{16,}+|AIza[0-9A-Za-z_-]{35}|eyJ[A-Za-z0-9_-]{10,}+\.[A-Za-z0-9_.-]{10,}+"
BENIGN = r"sha\d*|md5|checksum|digest|commit|rev(?:ision)?|uuid|guid|hash|version|href|src|url|file|path|mail|page|doi|isbn|image|build|id"
COMMON = "about access account address admin api app auth backup base book build class client cloud code com commit config content count data date default demo dev doc domain download email error event example file font form group guide hash head home host html http image index info item key lang left level library license link list local login mail main master media menu message model module name node note number object option order page param pass password path photo plan port post product project public query release report request root sample script search secret section server service session setting site size source staging static status store string style system table tag target task team temp template test text theme thread time title token tool type update upload user value version video view web widget width window word work your".split()
PLACEHOLDER = r"example|changeme|change_me|placeholder|dummy|sample|redacted|your|xxx|\*\*\*|\.\.\.|<|\$\{|%s|foobar|12345|abcdef|0000|1111"

KEY = "[A-Z0-9 ]*PRIVATE KEY(?: BLOCK)?-----"
#: A private key to its END line or, without one, to the end of its base64 lines.
PEM = rf"-----BEGIN {KEY}(?:(?>(?s:.)*?-----)END {KEY}|\s*[A-Za-z0-9+/=\r\n]*(?<=[A-Za-z0-9+/=])(?![A-Za-z0-9+/=]|[ \t]*[A-Za-z,.;:'!?()-]))?"
VALUE = r"[^\s\"'<>,;]"
#: Names begin after anything but a letter, and formats and tokens at a run's start. No part has a greatest length. A token that holds an assignment is left to it.
ASSIGNMENT = rf"(?<![A-Za-z])(?i:{NAMES})s?[\"']?\s{{0,3}}[:=]\s{{0,3}}[\"']?{VALUE}"
TOKEN = rf"(?<![A-Za-z0-9+/_=-])(?=[A-Za-z_+/=-]*+[0-9])(?=[A-Za-z0-9+/_=-]{{16}})(?![A-Za-z0-9+/_=-]*?{ASSIGNMENT}{{6}})[A-Za-z0-9+/_=-]{{16,}}+"
CANDIDATE = rf"{ASSIGNMENT}{{6,}}+|(?<![A-Za-z0-9])(?:{FORMATS})|{PEM}|{TOKEN}"
ASSIGNED = rf"(?i)^(?:{NAMES})s?[\"']?\s{{0,3}}[:=]\s{{0,3}}[\"']?({VALUE}{{6,}})$"
FEATURES = ["size", "digits", "uppers", "lowers", "others", "transitions", "distinct", "dictionary", "slashes", "dots", "hex", "uuid", "assigned", "format", "placeholder", "secret_near", "benign_near", "at_near", "runs"]


#: Noncharacters to mark candidates with: the first that a text hasn't got.
MARKS = "\uffff", "\ufffe", "\ufdd0"


def dictionary(docs: DataFrame, most: int = WORDS) -> list[str]:
    """The words of at least LETTERS letters that most documents have, at most that many; ties by the word. Counted over all of docs."""
    words = F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(rf"\p{{L}}{{{LETTERS},}}"), F.lit(0)))
    counts = docs.select(F.explode(words).alias("word")).groupBy("word").agg(F.count("*").alias("n"))
    return sorted({r.word for r in counts.orderBy(F.desc("n"), "word").limit(most).collect()} | {w for w in COMMON if len(w) >= LETTERS})


def with_parts(docs: DataFrame, column: str) -> DataFrame:
    """docs with a column of text's parts: what is before the first candidate, the candidate, what is between it and the next, and so on.

    Columns that a later lambda reads are referred to twice there, so that they are made once for a row and not once for each of its candidates.
    """
    text = F.col("text")
    mark = F.coalesce(*(F.when(~F.contains(text, F.lit(m)), F.lit(m)) for m in MARKS), F.lit(MARKS[0]))
    clean = F.when(mark == MARKS[0], F.translate(text, MARKS[0], " ")).otherwise(text)
    marked = F.regexp_replace(clean, F.lit(CANDIDATE), F.concat(mark, F.lit("$0"), mark))
    return docs.withColumn(column, F.coalesce(F.split(marked, mark, -1), F.array(F.lit(""))))


def candidates(parts: Column) -> Column:
    """Array of (i, value, lead, shown, before, after, assigned) for a column of parts: value is what an assignment assigns, lead what of the candidate precedes it, shown what features look at."""
    n = F.floor(F.size(parts) / 2).cast("int")
    found = F.transform(F.slice(F.sequence(F.lit(0), n), F.lit(1), n), lambda i: F.struct(i.alias("i"), F.get(parts, 2 * i + 1).alias("x"), F.right(F.get(parts, 2 * i), F.lit(40)).alias("gap"), F.left(F.get(parts, 2 * i + 2), F.lit(20)).alias("after")))
    found = F.transform(found, lambda c: F.struct(c["i"].alias("i"), c["x"].alias("x"), c["gap"].alias("gap"), c["after"].alias("after"), F.regexp_extract(c["x"], ASSIGNED, 1).alias("value"), F.regexp_extract(c["x"], f"^-----BEGIN {KEY}", 0).alias("key")))

    def one(c: Column) -> Column:
        assigned = c["value"] != ""
        value = F.when(assigned, c["value"]).otherwise(c["x"])
        lead = F.left(c["x"], F.length(c["x"]) - F.length(value))
        return F.struct(c["i"].alias("i"), value.alias("value"), lead.alias("lead"), F.when(c["key"] != "", c["key"]).otherwise(value).alias("shown"), F.lower(F.concat(c["gap"], lead)).alias("before"), c["after"].alias("after"), assigned.alias("assigned"))

    return F.transform(found, one)


def features(c: Column, words: list[str]) -> Column:
    """The FEATURES of a candidate (shown, before, after, assigned), all doubles; a private key is known by its first line. words: the dictionary."""
    v, before = c["shown"], c["before"]
    n = F.greatest(F.length(v), F.lit(1))

    def share(pattern: str) -> Column:
        return F.regexp_count(v, F.lit(pattern)) / n

    kinds = reduce(lambda x, p: F.regexp_replace(x, *p), ((r"[a-z]", "a"), (r"[A-Z]", "B"), (r"[0-9]", "0"), (r"[^aB0]", "_")), v)
    runs = F.regexp_extract_all(v, F.lit(r"\p{Lu}?\p{Ll}+|\p{Lu}+|\p{L}"), F.lit(0))
    known = F.aggregate(F.transform(runs, lambda w: F.when(F.lower(w).isin(*words), F.length(w)).otherwise(0)), F.lit(0), lambda a, x: a + x)
    own = {
        "size": n,
        "digits": share("[0-9]"),
        "uppers": share("[A-Z]"),
        "lowers": share("[a-z]"),
        "others": share("[^A-Za-z0-9]"),
        "transitions": F.length(F.regexp_replace(kinds, r"(.)\1+", "$1")) / n,
        "distinct": F.size(F.array_distinct(F.split(v, ""))) / n,
        "dictionary": known / n,
        "slashes": F.regexp_count(v, F.lit("/")),
        "dots": F.regexp_count(v, F.lit(r"[.]")),
        "hex": v.rlike("^[0-9a-fA-F]+$"),
        "uuid": v.rlike("^[0-9a-fA-F]{8}-([0-9a-fA-F]{4}-){3}[0-9a-fA-F]{12}$"),
        "assigned": c["assigned"],
        "format": v.rlike(f"^(?:{FORMATS}|{PEM})$"),
        "placeholder": v.rlike(f"(?i){PLACEHOLDER}"),
        "secret_near": before.rlike(rf"(?:{NAMES})\W{{0,12}}(?:is|=|:)?\W{{0,6}}$"),
        "benign_near": before.rlike(rf"(?:^|\W)(?:{BENIGN})\W{{0,6}}(?:is|=|:)?\W{{0,6}}$"),
        "at_near": before.rlike(r"(?:@|://|www\.)\S*$") | c["after"].rlike(r"^(?:@|\.[a-z]{2,4}\b)"),
        "runs": F.length(F.regexp_replace(v, r"(.)\1+", "$1")) / n,
    }
    return F.struct(*(own[k].cast("double").alias(k) for k in FEATURES))


def sample_findings(spark: SparkSession, n: int = 6000) -> DataFrame:
    """Labelled findings (value, before, after, assigned, label) to train from where a team has none of its own.

    Made up by rule from seeds: row i's kind is i modulo the number of kinds, its characters come from hashes of i.
    """
    hexa, number = F.sha2(F.col("id").cast("string"), 256), F.pmod(F.xxhash64("id"), F.lit(1000)).cast("string")
    mixed = F.regexp_replace(F.base64(F.unhex(F.sha2(F.concat(F.lit("m"), F.col("id").cast("string")), 256))), "[=+/]", "")
    upper = F.upper(F.regexp_replace(F.base64(F.unhex(F.sha2(F.concat(F.lit("u"), F.col("id").cast("string")), 256))), "[=+/]", ""))
    some = F.pmod(F.xxhash64("id", F.lit(3)), F.lit(12)).cast("int")

    def word(salt: int) -> Column:
        return F.get(F.array(*map(F.lit, COMMON)), F.pmod(F.xxhash64("id", F.lit(salt)), F.lit(len(COMMON))).cast("int"))

    empty = F.lit("")
    kinds = [  # value, before, after, assigned, label
        (F.concat(F.lit("AKIA"), F.left(upper, F.lit(16))), empty, F.lit(" "), 0, 1),
        (F.left(hexa, F.lit(16) + some), F.lit("password="), F.lit(" "), 1, 1),
        (F.left(hexa, F.lit(40)), F.lit('token = "'), F.lit('"'), 1, 1),
        (F.left(mixed, F.lit(20) + some), F.lit("api_key: "), F.lit("\n"), 1, 1),
        (F.concat(F.lit("ghp_"), F.left(mixed, F.lit(36))), F.lit("use "), F.lit(" "), 0, 1),
        (F.concat(F.lit("sk_live_"), F.left(mixed, F.lit(24))), F.lit("key "), F.lit("."), 0, 1),
        (F.left(mixed, F.lit(32) + some), F.lit("the secret is "), F.lit(" "), 0, 1),
        (F.concat(F.left(mixed, F.lit(8)), F.lit("!"), F.left(hexa, F.lit(4))), F.lit("passwd: "), F.lit("\n"), 1, 1),
        (F.concat(F.lit("xoxb-"), F.regexp_replace(F.left(hexa, F.lit(24)), "[a-f]", "7"), F.lit("-"), F.left(mixed, F.lit(12))), F.lit("slack "), F.lit(" "), 0, 1),
        (F.lit("-----BEGIN RSA PRIVATE KEY-----"), F.lit("\n"), F.lit("\n"), 0, 1),
        (F.left(hexa, F.lit(40)), F.lit("commit "), F.lit("\n"), 0, 0),
        (hexa, F.lit("sha256: "), F.lit(" "), 0, 0),
        (F.left(hexa, F.lit(32)), F.lit("md5 checksum "), F.lit(" "), 0, 0),
        (F.regexp_replace(F.left(hexa, F.lit(32)), "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5"), F.lit(" id: "), F.lit(" "), 0, 0),
        (F.concat(word(1), F.lit("_"), word(2), F.lit("_"), word(4), number), F.lit(" "), F.lit(" "), 0, 0),
        (F.concat(F.lit("your_"), word(1), F.lit("_here"), number), F.lit("password="), F.lit(" "), 1, 0),
        (F.concat(F.lit("example"), word(1), number), F.lit("token: "), F.lit(" "), 1, 0),
        (F.repeat(F.lit("x"), F.lit(8) + some), F.lit("secret="), F.lit(" "), 1, 0),
        (F.concat(word(1), F.lit("/"), word(2), F.lit("/"), word(4), F.lit("-"), number), F.lit("href=/"), F.lit(" "), 0, 0),
        (F.concat(word(1), number, F.lit("/2024/05/"), word(2)), F.lit("https://www."), F.lit("."), 0, 0),
        (F.concat(word(1), F.lit("-"), word(2), F.lit("-"), word(4), F.lit("-"), number), F.lit("file "), F.lit(".zip"), 0, 0),
        (F.concat(F.lit("2024-05-1"), F.left(number, F.lit(1)), F.lit("T10"), number), F.lit("date "), F.lit("Z"), 0, 0),
        (F.repeat(F.left(number, F.lit(1)), F.lit(16) + some), F.lit(" "), F.lit(" "), 0, 0),
        (F.concat(F.lit("process.env."), F.upper(word(1))), F.lit("password: "), F.lit(","), 1, 0),
        (F.concat(word(1), word(2), number), F.lit("auth: "), F.lit(" "), 1, 0),
        (F.concat(F.lit("AKIAIOSFODNN7EXAMP"), F.lit("LE")), F.lit("key "), F.lit(" "), 0, 0),
        (F.concat(word(1), F.lit("="), word(2), F.lit("_"), number, F.lit("_"), word(4)), F.lit("?"), F.lit(" "), 0, 0),
    ]
    which = F.pmod(F.col("id"), F.lit(len(kinds)))
    row = F.coalesce(*(F.when(which == k, F.struct(v.alias("value"), b.alias("before"), a.alias("after"), F.lit(bool(g)).alias("assigned"), F.lit(float(y)).alias("label"))) for k, (v, b, a, g, y) in enumerate(kinds)))
    return spark.range(0, n, 1, 1).select(row.alias("c")).select("c.*")


def train_forest(findings: DataFrame, words: list[str], seed: int = 11) -> str:
    """SQL for a candidate's chance to be a secret, from its features, which are c.f in a lambda over candidates c.

    findings: (value, before, after, assigned, label), of which the classifier takes all; words: the dictionary.
    """
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.feature import VectorAssembler

    rows = shaped(findings, words).select("f.*", "label")
    data = VectorAssembler(inputCols=FEATURES, outputCol="features").transform(rows).select("features", "label")
    model = RandomForestClassifier(numTrees=TREES, maxDepth=DEPTH, seed=seed, minInstancesPerNode=3, maxBins=64).fit(data)

    def sql(node) -> str:
        if node.getClass().getSimpleName() == "LeafNode":
            stats = list(node.impurityStats().stats())
            return repr(stats[1] / sum(stats)) + "D"
        split = node.split()
        return f"CASE WHEN c.f.{FEATURES[split.featureIndex()]} <= {split.threshold()!r}D THEN {sql(node.leftChild())} ELSE {sql(node.rightChild())} END"

    return "(" + " + ".join(sql(t._java_obj.rootNode()) for t in model.trees) + f") / {len(model.trees)}D"


def shaped(findings: DataFrame, words: list[str]) -> DataFrame:
    """f and label of labelled findings."""
    first = F.regexp_extract("value", f"^-----BEGIN {KEY}", 0)
    shown = findings.select(F.when(first != "", first).otherwise(F.col("value")).alias("shown"), F.lower("before").alias("before"), "after", "assigned", F.col("label").cast("double").alias("label"))
    return shown.select(features(F.struct("shown", "before", "after", "assigned"), words).alias("f"), "label")


def with_findings(docs: DataFrame, forest: str, words: list[str], parts: str, column: str) -> DataFrame:
    """docs with columns parts (with_parts()) and column, an array of (i, value, lead, score) for all candidates in text, in order."""
    listed = F.transform(candidates(F.col(parts)), lambda c: F.struct(c["i"].alias("i"), c["value"].alias("value"), c["lead"].alias("lead"), features(c, words).alias("f")))
    scored = f"transform(`{column}`, c -> named_struct('i', c.i, 'value', c.value, 'lead', c.lead, 'score', {forest}))"
    return with_parts(docs, parts).withColumn(column, listed).withColumn(column, F.expr(scored))


def scan(docs: DataFrame, forest: str, words: list[str]) -> DataFrame:
    """doc_id, start, n_chars, score and secret (score >= 0.5) of every candidate in every text.

    start counts characters from 0. A null or empty text has no candidates; repeated rows give repeated findings; texts and candidates of any length are
    taken whole, in work that grows with the text and the power 1.5 of its number of candidates. Other columns are ignored. An empty table gives no row.
    """
    found = with_findings(docs.select("doc_id", "text"), forest, words, "parts", "found")
    # no filter here: it would be pushed below the columns and repeat them; running sums of the parts' sizes: within blocks of about the square root of their number, and over blocks
    found = found.withColumn("sizes", F.transform("parts", F.length)).withColumn("block", F.ceil(F.sqrt(F.size("parts"))).cast("int"))

    def total(x: Column, start: Column, n: Column) -> Column:
        return F.aggregate(F.slice(x, start + 1, n), F.lit(0).cast("long"), lambda a, y: a + y)

    steps = F.sequence(F.lit(0), F.floor((F.size("parts") - 1) / F.col("block")).cast("int"))
    found = found.withColumn("sums", F.when(F.size("sizes") > 0, F.transform(steps, lambda k: total(F.col("sizes"), k * F.col("block"), F.col("block")))))
    found = found.withColumn("upto", F.when(F.size("sums") > 0, F.transform(steps, lambda k: total(F.col("sums"), F.lit(0), k))))

    def one(c: Column) -> Column:
        at = 2 * c["i"] + 1
        block = F.floor(at / F.col("block")).cast("int")
        start = F.get(F.col("upto"), block) + total(F.col("sizes"), block * F.col("block"), at - block * F.col("block")) + F.length(c["lead"])
        return F.struct(start.alias("start"), F.length(c["value"]).cast("long").alias("n_chars"), c["score"].alias("score"))

    placed = F.when((F.size("sizes") > 0) & (F.size("upto") > 0), F.transform("found", one))
    found = found.select("doc_id", F.explode(placed).alias("c"))
    return found.select("doc_id", "c.start", "c.n_chars", F.round("c.score", 6).alias("score"), (F.col("c.score") >= 0.5).alias("secret"))


def redact(docs: DataFrame, forest: str, words: list[str], mark: str = MARK) -> DataFrame:
    """docs with each secret in text replaced by mark; all rows and columns stay, whatever their names, and a null text stays null. See scan().

    In a text that holds all three noncharacters of MARKS and a secret, U+FFFF becomes a space.
    """
    parts, column = common.unused("_parts", docs), common.unused("_found", docs)
    found = with_findings(docs, forest, words, parts, column)
    own, rest = F.col(column), F.col(parts)
    # each candidate and the gap after it
    pieces = F.transform(own, lambda c: F.concat(F.when(c["score"] >= 0.5, F.concat(c["lead"], F.lit(mark))).otherwise(F.get(rest, 2 * c["i"] + 1)), F.get(rest, 2 * c["i"] + 2)))
    done = F.concat(F.get(rest, F.lit(0)), F.array_join(pieces, ""))
    return found.withColumn("text", F.when(F.exists(column, lambda c: c["score"] >= 0.5), done).otherwise(F.col("text"))).select(*docs.columns)
