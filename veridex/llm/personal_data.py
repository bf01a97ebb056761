"""Personal data by boosted candidates, in DataFrame functions alone.

Formats that hold by themselves (``BASE``: e-mail, IP address, card number, phone number) are found first and always
stay. Generators of high recall then propose spans in what is left: secrets after a telling name, with spaces where
quoted, keys of capitals and digits, tokens with a prefix or after "Bearer", web tokens and private key blocks, numbers
written like phone or card numbers; spans of different generators may overlap. Boosted trees judge each
by its format and context, and a threshold per generator, calibrated on held-out rows for precision, selects.

The trees are fitted on ``TRAINING_ROWS`` rows made from templates, a fixed number; their features come from the same
expressions as those of the documents. Scores are CASE expressions, so the path over the documents is one narrow stage.

Positions come from what lies between matches: ``split`` and ``regexp_extract_all`` by one pattern give pieces and
matches, and lengths sum up to code points. Patterns use possessive quantifiers, and begin only where a match can begin,
so that long texts cost linear time and no stack.

Null texts are empty: no spans. Rows with equal or null ids are judged one by one. An empty table gives no rows.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veridex.llm._common import _quoted, id_and_text, table
from veridex.llm.boosting import fitted, score_column, scores

#: Kind, pattern, and a cheap test that texts without a match mostly fail. The lookbehind or \G keeps a match from
#: beginning within a run that cannot match.
BASE = (
    ("email", r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "@"),
    ("ip", r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", r"[0-9]\.[0-9]"),
    ("card", r"[0-9](?:[\x20-]?[0-9])++", r"[0-9](?:[\x20-]?[0-9]){15}"),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", r"\+[0-9]"),
)
#: Generator, kind of what it proposes, pattern, test.
GENERATORS = (
    ("named", "secret", r"(?i)(?<![a-z0-9])(?:passwords?|passwd|pwd|token|secret|api[_-]?key|access[_-]?key)[\x22']?\s{0,3}[=:]\s{0,3}(?:\x22[^\x22\n]{4,200}\x22|'[^'\n]{4,200}'|[\x22']?[^\s\x22']{4,}+)", r"[=:]"),
    ("key", "secret", r"(?<![A-Za-z0-9])[A-Z0-9]{16,}+(?![A-Za-z0-9])", r"[A-Z0-9]{16}"),
    ("token", "secret", r"(?:-----BEGIN [A-Z\x20]{0,40}PRIVATE KEY(?: BLOCK)?-----[A-Za-z0-9+/=\s]*+(?:-----END [A-Z\x20]{0,40}PRIVATE KEY(?: BLOCK)?-----)?|(?<![A-Za-z0-9])(?i:bearer)\s{1,3}[A-Za-z0-9._~+/=-]{12,}+|(?<![A-Za-z0-9_.-])eyJ[A-Za-z0-9_-]{5,}+\.[A-Za-z0-9_-]{5,}+\.[A-Za-z0-9_-]{5,}+|(?<![A-Za-z0-9_-])[A-Za-z]{2,12}[_-](?:[A-Za-z0-9]{1,12}[_-])?[A-Za-z0-9]{16,}+)", r"-----BEGIN|(?i:bearer)\s|[_-][A-Za-z0-9]{16}|eyJ"),
    ("number", "phone", r"(?<![0-9+.])[(]?[0-9](?:[\x20()./-]{0,2}[0-9]){6,}+(?![0-9])", r"[0-9][^0-9]{0,2}[0-9]{2}"),
)
ORDER = ("email", "ip", "card", "phone", "secret")
PHONE_WORDS = r"(?i)(?:tel|phone|call|fax|mobile|cell|whatsapp|contact)[a-z]*[\x20:.]{0,3}$"
FEATURES = ("digits", "length", "upper", "lower", "separators", "brackets", "groups", "longest", "phone_word", "named", "before", "after", "pattern")
TRAINING_ROWS = 4000
MASK = "\0"
BLOCK = 256
CHUNK = 1024


def _running(lengths: Column, combine=lambda x, y: x + y) -> Column:
    """Sums of the values before each, or what else ``combine`` gives from 0 on, of an array of any length: in blocks,
    since appending copies an array."""
    blocks = F.transform(F.sequence(F.lit(0), F.greatest(F.floor((F.size(lengths) - 1) / BLOCK), F.lit(0))), lambda b: F.slice(lengths, (b * BLOCK + 1).cast("int"), F.lit(BLOCK)))

    def sums(of: Column) -> Column:
        return F.aggregate(of, F.array(F.lit(0)), lambda acc, x: F.array_append(acc, combine(F.element_at(acc, -1), x)))

    before = F.transform(blocks, sums)
    base = sums(F.transform(before, lambda x: F.element_at(x, -1)))
    return F.flatten(F.transform(before, lambda x, b: F.transform(F.slice(x, 1, F.size(x) - 1), lambda y: combine(y, base[b]))))


def _digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    each = F.transform(F.filter(F.split(F.reverse(digits), ""), lambda x: x != ""), lambda x, k: F.when(k % 2 == 1, 2 * x.cast("int") - F.when(x.cast("int") > 4, 9).otherwise(0)).otherwise(x.cast("int")))
    return F.aggregate(each, F.lit(0), lambda a, x: a + x) % 10 == 0


def valid(kind: str, match: Column) -> Column:
    if kind == "ip":
        return F.forall(F.split(match, r"\."), lambda p: (F.length(F.regexp_replace(p, "^0+", "")) <= 3) & (F.right(F.concat(F.lit("000"), p), F.lit(3)).cast("int") <= 255))
    n = F.length(_digits(match))
    if kind == "card":
        return n.between(16, 19) & _luhn(_digits(match))
    return n.between(8, 15) if kind == "phone" else F.lit(True)


def settled(df: DataFrame, **columns: Column) -> DataFrame:
    """Adds columns by a generator of one row: what follows refers to their values, where a projection would be merged
    with those above and repeat the expressions at each use."""
    names = [_quoted(n) for n in df.columns if n not in columns]
    made = df.select(*names, F.explode(F.array(F.struct(*(c.alias(n) for n, c in columns.items())))).alias("_settled"))
    return made.select(*names, *(F.col("_settled")[n].alias(n) for n in columns))


def with_matches(df: DataFrame, text: str, pattern: str, test: str, name: str) -> DataFrame:
    """Adds ``name_parts`` and ``name_hits``: what lies between the pattern's matches, and these."""
    some = F.contains(F.col(text), F.lit(test)) if test == "@" else F.col(text).rlike(test)
    return settled(df, **{
        f"{name}_parts": F.when(some, F.split(F.col(text), pattern, -1)).otherwise(F.array(F.col(text))),
        f"{name}_hits": F.when(some, F.regexp_extract_all(F.col(text), F.lit(pattern), F.lit(0))).otherwise(F.array().cast("array<string>")),
    })


def with_starts(df: DataFrame, name: str) -> DataFrame:
    """Adds ``name_starts``: code points before each match."""
    lengths = F.transform(f"{name}_hits", lambda h, i: F.length(F.get(F.col(f"{name}_parts"), i)) + F.length(h))
    df = settled(df, **{f"{name}_lengths": lengths})
    sums = F.when(F.size(f"{name}_lengths") > 0, _running(F.col(f"{name}_lengths"))).otherwise(F.array().cast("array<int>"))
    return settled(settled(df, **{f"{name}_sums": sums}), **{f"{name}_starts": F.transform(f"{name}_sums", lambda s, i: s + F.length(F.get(F.col(f"{name}_parts"), i)))})


def replaced(name: str, new) -> Column:
    """The text again with each match ``h``, the i-th, as ``new(h, i)``."""
    kept = F.transform(f"{name}_hits", new)
    return F.array_join(F.zip_with(f"{name}_parts", kept, lambda p, h: F.concat(p, F.coalesce(h, F.lit("")))), "")


def _count(text: Column, pattern: str) -> Column:
    return F.length(text) - F.length(F.regexp_replace(text, pattern, ""))


def _features(generator: str, match: Column, left: Column, right: Column) -> Column:
    value = F.when(F.lit(generator == "named"), F.regexp_replace(match, r"^[^=:]*[=:]\s*[\x22']?", "")).otherwise(match)
    runs = F.filter(F.split(value, "[^0-9]+"), lambda x: x != "")
    of = (
        F.length(_digits(value)), F.length(value), _count(value, "[A-Z]"), _count(value, "[a-z]"), _count(value, r"[\x20()./-]"), _count(value, "[()]"), F.size(runs),
        F.coalesce(F.array_max(F.transform(runs, F.length)), F.lit(0)), left.rlike(PHONE_WORDS).cast("int"), F.lit(int(generator == "named")),
        F.right(left, F.lit(1)).rlike("[A-Za-z0-9]").cast("int"), F.left(right, F.lit(1)).rlike("[A-Za-z0-9%]").cast("int"),
        value.rlike(r"^[(]?[0-9]{3}[)]?[\x20.-]?[0-9]{3}[\x20.-][0-9]{4}$|^0[0-9]{1,4}[\x20/-][0-9]").cast("int"),
    )
    return F.struct(*(x.alias(n) for x, n in zip(of, FEATURES)))


def with_candidates(df: DataFrame, text: str) -> DataFrame:
    """Adds for each generator its matches in ``text`` and ``g_features``, an array of feature structs."""
    for g, _, pattern, test in GENERATORS:
        df = _with_features(with_matches(df, text, pattern, test, g), g)
    return df


def _with_features(df: DataFrame, g: str) -> DataFrame:
    parts = F.col(f"{g}_parts")
    return settled(df, **{f"{g}_features": F.transform(f"{g}_hits", lambda h, i: _features(g, h, F.right(F.get(parts, i), F.lit(24)), F.left(F.get(parts, i + 1), F.lit(24))))})


def training_rows(spark: SparkSession, rows: int = TRAINING_ROWS) -> DataFrame:
    """``id, label, text``: templates of secrets and phone numbers, and of what only looks like them."""

    def pick(salt: int, *of: str) -> Column:
        return F.array(*map(F.lit, of))[F.pmod(F.xxhash64("id", F.lit(salt)), F.lit(len(of))).cast("int")]

    def code(salt: int, size: int, alphabet: str) -> Column:
        hexed = F.sha2(F.concat_ws("-", "id", F.lit(salt)), 256)
        return F.translate(F.substring(hexed, 1, size), "0123456789abcdef", alphabet)

    def digits(salt: int, size: int) -> Column:
        return F.lpad(F.pmod(F.xxhash64("id", F.lit(salt)), F.lit(10**size)).cast("string"), size, "0")

    def long(x: Column) -> Column:
        """Some of the values are long ones, up to several hundred characters."""
        return F.repeat(x, F.when(F.pmod(F.xxhash64("id", F.lit(80)), F.lit(4)) == 0, F.pmod(F.xxhash64("id", F.lit(81)), F.lit(30)) + 1).otherwise(1).cast("int"))

    hexa, upper, letters, mixed, few = "0123456789abcdef", "A2BC3DEF4GHJ5KL7", "abcdefghiklmnoprst"[:16], "aB3dE5gH7jK9mN1p", "ab@defg0iklmno7p"
    templates = (
        (1, F.concat(pick(1, "password=", "passwd: ", "pwd=", "Password = "), long(code(2, 18, hexa)))),
        (1, F.concat(pick(3, "token = \"", "secret: '", "api_key=\"", "API-Key: "), long(code(4, 40, hexa)), F.lit("\""))),
        (1, F.concat(pick(5, "AKIA", "ASIA", ""), long(code(6, 20, upper)))),
        (1, F.concat(pick(7, "Tel. ", "phone: ", "call ", ""), F.lit("("), digits(8, 3), F.lit(") "), digits(9, 3), F.lit("-"), digits(10, 4))),
        (1, F.concat(pick(11, "phone ", "mobile: ", "fax ", "tel: "), digits(12, 3), pick(13, "-", " ", "."), digits(14, 3), pick(15, "-", " "), digits(16, 4))),
        (1, F.concat(pick(17, "Tel: ", "call "), F.lit("0"), digits(18, 3), pick(19, " ", "/", "-"), digits(20, 7))),
        (1, F.concat(pick(46, "sk_live_", "ghp_", "xoxb-", "glpat-", "pk_test_", "key-"), long(code(47, 24, mixed)))),
        (1, F.concat(pick(48, "Bearer ", "bearer ", "Authorization: Bearer "), long(code(49, 40, mixed)))),
        (1, F.concat(F.lit("eyJ"), code(50, 20, mixed), F.lit(".eyJ"), long(code(51, 30, mixed)), F.lit("."), code(52, 40, mixed))),
        (1, F.concat(F.lit("-----BEGIN "), pick(53, "", "RSA ", "EC "), F.lit("PRIVATE KEY-----\n"), long(code(54, 60, mixed)), F.lit("\n-----END PRIVATE KEY-----"))),
        (1, F.concat(pick(55, "password=\"", "db_password: \"", "client_secret = \""), code(56, 7, few), pick(57, " ", "$ ", " & "), code(58, 5, few), digits(74, 1), code(75, 1, few), F.lit("\""))),
        (1, F.concat(pick(59, "client_secret=\"", "aws_secret = '", "auth_token="), code(60, 16, hexa), F.lit("\""))),
        (0, F.concat(pick(61, "well-", "pre_", "non-", "inter_", "self-"), code(62, 20, letters))),
        (0, F.concat(pick(63, "bearer ", "Bearer "), code(64, 14, letters))),
        (0, F.concat(pick(65, "password: \"", "secret = \"", "token: \""), code(66, 5, letters), F.lit(" "), code(67, 7, letters), F.lit(" "), code(68, 4, letters), F.lit("\""))),
        (0, F.concat(pick(69, "DE89 ", "FR76 ", "IBAN NL91 ", "ES12 "), digits(70, 4), F.lit(" "), digits(71, 4), F.lit(" "), digits(72, 4), F.lit(" "), digits(73, 4), F.lit(" "), digits(74, 2))),
        (0, F.concat(pick(21, "password=", "token: ", "secret = ", "pwd: "), pick(22, "required", "letters only", "none given", "please", "something"), code(23, 3, letters))),
        (0, F.concat(pick(24, "CONGRATULATIONS", "INTERNATIONALLY", "ADMINISTRATIONS"), F.upper(code(25, 6, letters)))),
        (0, F.concat(F.lit("20"), digits(26, 2), F.lit("-0"), digits(27, 1), F.lit("-1"), digits(28, 1), pick(29, " 10", "", " 1200"))),
        (0, F.concat(digits(30, 4), pick(31, ".", " ", "/"), digits(32, 3), pick(33, ".", " ", "/"), digits(34, 3))),
        (0, F.concat(pick(35, "order ", "no. ", "id ", "ISBN "), digits(36, 12))),
        (0, F.concat(digits(37, 3), F.lit("-"), digits(38, 1), F.lit("-"), digits(39, 4), F.lit("-"), digits(40, 4), F.lit("-"), digits(41, 1))),
        (0, digits(42, 17)),
        (0, F.concat(F.lit("1"), digits(43, 3), F.lit("-1"), digits(44, 3), F.lit(" ("), digits(45, 2), F.lit(")"))),
    )
    n = len(templates)
    label, made = F.lit(0), F.lit("")
    for k, (y, text) in enumerate(templates):
        at = F.col("id") % n == k
        label, made = F.when(at, y).otherwise(label), F.when(at, text).otherwise(made)
    text = F.concat(pick(90, "and then ", "the ", "", "of them, "), made, pick(91, " and", ". Then", "", ", so"))
    return spark.range(rows).select("id", label.alias("label"), text.alias("text"))


def judges(spark: SparkSession, least_precision: float = 0.99) -> tuple[list, dict[str, float]]:
    """Trees, and each generator's lowest threshold that keeps the precision on held-out rows (infinite if none does)."""
    rows = with_candidates(training_rows(spark), "text")
    each = reduce(DataFrame.union, (rows.select("id", "label", F.lit(g).alias("g"), F.explode(f"{g}_features").alias("x")).select("id", "label", "g", *(f"x.{f}" for f in FEATURES)) for g, *_ in GENERATORS))
    found = each.orderBy("id", "g", *FEATURES).collect()
    x = np.array([[r[f] for f in FEATURES] for r in found], np.int64)
    y, held = np.array([r["label"] for r in found], float), np.array([r["id"] // 16 % 2 == 1 for r in found])
    names = np.array([r["g"] for r in found])
    trees = fitted(x[~held], y[~held])
    limits = {}
    for g, *_ in GENERATORS:
        at = held & (names == g)
        s, t = scores(trees, x[at]), y[at]
        order = np.argsort(-s, kind="stable")
        precise = np.cumsum(t[order]) / np.arange(1, len(t) + 1)
        ok = np.flatnonzero(precise >= least_precision)
        limits[g] = float(s[order][ok[-1]]) if len(ok) else float("inf")
    return trees, {g: max(v, 0.0) for g, v in limits.items()}


def _bounds(starts: str, hits: str) -> Column:
    return F.zip_with(starts, hits, lambda s, h: F.struct(s.alias("s"), (s + F.length(h)).alias("e")))


def _joined(spans: list[tuple[str, Column]]) -> Column:
    return F.array_join(F.concat(*(F.transform(c, lambda x: F.concat_ws(":", F.lit(k), x["s"], x["e"])) for k, c in spans)), ",")


def _masked(df: DataFrame) -> DataFrame:
    """Adds ``masked``: ``text`` with valid base matches as runs of ``MASK``, one kind after another."""
    df = df.withColumn("masked", F.col("text"))
    for kind, pattern, test in BASE:
        df = with_matches(df, "masked", pattern, test, f"m_{kind}")
        df = settled(df, masked=F.when(F.size(f"m_{kind}_hits") > 0, replaced(f"m_{kind}", lambda h, i: F.when(valid(kind, h), F.repeat(F.lit(MASK), F.length(h))).otherwise(h))).otherwise(F.col("masked"))).drop(f"m_{kind}_hits", f"m_{kind}_parts")
    return df


def _chosen(df: DataFrame, g: str, trees: list, limit: float) -> DataFrame:
    """Adds ``g_yes``: whether each of the generator's candidates is selected."""
    return settled(df, **{f"{g}_yes": F.transform(f"{g}_features", lambda x: score_column(trees, lambda f: x[FEATURES[f]]) >= limit)})


def _with_spans(df: DataFrame) -> tuple[DataFrame, list[Column]]:
    """Adds to a table with ``text`` the base spans of each kind, and those of each generator (``g_spans``); also gives
    what is to be listed: all spans by kind, as in ``ORDER``."""
    trees, limits = judges(df.sparkSession)
    for kind, pattern, test in BASE:
        df = with_starts(with_matches(df, "text", pattern, test, kind), kind)
        df = settled(df, **{kind: F.transform(F.filter(F.zip_with(f"{kind}_starts", f"{kind}_hits", lambda s, h: F.struct(s.alias("s"), h.alias("h"))), lambda x: valid(kind, x["h"])), lambda x: F.struct(x["s"].alias("s"), (x["s"] + F.length(x["h"])).alias("e")))})
        df = df.drop(*(f"{kind}_{x}" for x in ("parts", "hits", "lengths", "sums", "starts")))
    df = with_candidates(_masked(df), "masked")
    added: dict[str, list[Column]] = {}
    for g, kind, *_ in GENERATORS:
        df = with_starts(_chosen(df, g, trees, limits[g]), g)
        some = F.filter(F.zip_with(_bounds(f"{g}_starts", f"{g}_hits"), f"{g}_yes", lambda x, yes: F.struct(x["s"].alias("s"), x["e"].alias("e"), yes.alias("yes"))), lambda x: x["yes"])
        df = settled(df, **{f"{g}_spans": F.transform(some, lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e")))})
        df = df.drop(*(f"{g}_{x}" for x in ("parts", "hits", "lengths", "sums", "starts", "features", "yes")))
        added.setdefault(kind, []).append(F.col(f"{g}_spans"))
    return df.drop("masked"), [F.array_sort(F.array_distinct(F.concat(*([F.col(k)] if k != "secret" else []), *added.get(k, [])))) for k in ORDER]


def personal_data(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_email, n_ip, n_card, n_phone`` (base spans), ``base_sha256``, ``spans``, ``n_added`` of every row."""
    df, every = _with_spans(id_and_text(df, id_col, text_col))
    base = [(k, F.col(k)) for k, *_ in BASE]
    return df.select(
        "doc_id", *(F.size(k).cast("long").alias(f"n_{k}") for k, *_ in BASE), F.sha2(_joined(base), 256).alias("base_sha256"), _joined([*zip(ORDER, every)]).alias("spans"),
        reduce(Column.__add__, (F.size(f"{g}_spans") for g, *_ in GENERATORS)).cast("long").alias("n_added"),
    )


def redacted(df: DataFrame, text_col: str = "text") -> DataFrame:
    """``df`` with all its columns; in the text the very spans of ``personal_data`` are labels such as ``<EMAIL>``. Spans
    that overlap are one label, by the kind of the first, the longest or the one listed first where two begin together.
    Null texts stay null."""
    names = df.columns
    inner = df.select(F.struct(*map(_quoted, names)).alias("row"), F.coalesce(_quoted(text_col), F.lit("")).alias("text"))
    inner, every = _with_spans(inner)
    spans = F.concat(*(F.transform(c, lambda x: F.struct(x["s"].alias("s"), (-x["e"]).alias("e"), F.lit(o).alias("o"))) for o, c in enumerate(every)))
    inner = settled(inner.select("row", "text", F.array_sort(spans).alias("found")), found=F.col("found"))
    ends = F.transform("found", lambda x: -x["e"])
    inner = settled(inner, before=F.when(F.size("found") > 0, _running(ends, F.greatest)).otherwise(F.array().cast("array<int>")), chunks=F.when(F.size("found") > 0, F.regexp_extract_all("text", F.lit(f"(?s).{{1,{CHUNK}}}"), F.lit(0))).otherwise(F.array().cast("array<string>")))

    def piece(start: Column, end: Column) -> Column:
        """Code points of the text from the chunks that they lie in: its cost doesn't grow with what is before."""
        first = F.floor(start / CHUNK).cast("int")
        some = F.slice("chunks", first + 1, F.floor(end / CHUNK).cast("int") - first + 1)
        return F.substring(F.array_join(some, ""), start - first * CHUNK + 1, end - start)

    labels = F.array(*(F.lit(f"<{k.upper()}>") for k in ORDER))
    with_labels = F.transform("found", lambda x, i: F.when(x["s"] >= F.get("before", i), F.concat(piece(F.get("before", i), x["s"]), F.get(labels, x["o"]))).otherwise(""))
    rest = piece(F.array_max(ends), F.length("text"))
    inner = settled(inner, made=F.when(F.size("found") > 0, F.concat(F.array_join(with_labels, ""), rest)).otherwise(F.col("text")))
    changed = F.when(F.col("row")[text_col].isNull(), None).otherwise(F.col("made"))
    return inner.select(*(changed.alias(n) if n == text_col else F.col("row")[n].alias(n) for n in names))


def op1_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal_data(table(spark, sf_dir, "documents"))
