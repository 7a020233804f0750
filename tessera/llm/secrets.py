"""Secret scans with character Markov models; DataFrame functions only.

Base kinds come from patterns: ``assign`` (a key word, a sign and a value of 12 or more characters), ``access``
(``AKIA...`` of 18 or more) and ``hex`` (16 or more lower-case hex digits). Two first-order Markov models of characters
add the kind ``random``: runs of 12 or more token characters, or what base spans leave of them, whose mean log-likelihood ratio
per character, random strings against ordinary identifiers, exceeds ``THRESHOLD``, or more for less than 20 characters, which must not be letters of one case alone. Where a run
does not, its pieces between ``/``, ``_``, ``=`` and ``-`` are scored by the same rule.

Both models are trained from labelled samples: random strings are values of base spans in a bounded sample of documents and
digests in several alphabets; ordinary ones are the sample's words elsewhere, alone and joined as identifiers. What
reaches the driver are counts of character pairs, at most ``SYMBOLS`` squared per label.

Spans are in code points, end exclusive. Everything is one narrow projection over the documents.

Cases: a null text is empty; texts without spans have an empty list; repeated rows are scanned each; an empty table gives
an empty result (and an untrained model, which adds nothing); a column named like the result is replaced.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import drop_kept, fresh_name, keep, table

# The kinds and their patterns; the lengths are what is left of a match by the rule for its kind.
KINDS = ["assign", "access", "hex", "random"]
WORDS = ["password", "passwd", "secret", "token", "apikey", "api_key"]
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
# A maximal run that is too short can't hold a longer one, so the least length may stand in these two patterns.
ACCESS = r"AKIA[A-Z0-9]{14,}"
HEX = r"[0-9a-f]{16,}"
LEAST_VALUE = 12
TOKEN = r"(?<![\p{L}\p{N}+/_=-])[A-Za-z0-9+/_=-]{12,}+(?![\p{L}\p{N}])"
PIECE = r"(?<![\p{L}\p{N}+])[A-Za-z0-9+]{12,}+(?![\p{L}\p{N}])"
LEAST_TOKEN, FULL_TOKEN = 12, 20
WORD = "^([A-Z]+|[A-Za-z][a-z]+)$"  # such short tokens are words, in capitals too

SAMPLE_DOCS, SAMPLE_DIGESTS, THRESHOLD = 400, 2000, 1.0
SYMBOLS = 128
SPANS = "array<struct<start: int, kind: int, end: int>>"


def _located(text: Column, pattern: str, kind: int, keep: Column | None = None, where: Column | None = None) -> Column:
    """Spans of all matches of a pattern, leftmost and apart: lengths of matches and of what lies between add up.

    ``keep``: an array as long as the matches that tells which of them stay. ``where``: texts that may match.
    """
    hits, gaps = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)
    nothing = F.array().cast("array<struct<start: int, end: int, at: int>>")

    def step(acc: Column, i: Column) -> Column:
        start = acc["pos"] + F.char_length(gaps_col[i])
        end = start + F.char_length(hits_col[i])
        return F.struct(end.alias("pos"), F.concat(acc["out"], F.array(F.struct(start.alias("start"), end.alias("end"), i.alias("at")))).alias("out"))

    # hits and gaps are bound once by a transform over a one-element array, so that a text is matched once for each
    def spans(pair: Column) -> Column:
        nonlocal hits_col, gaps_col
        hits_col, gaps_col = pair["hits"], pair["gaps"]
        zero = F.struct(F.lit(0).alias("pos"), nothing.alias("out"))
        found = F.when(F.size(hits_col) > 0, F.aggregate(F.sequence(F.lit(0), F.size(hits_col) - 1), zero, step, lambda acc: acc["out"]))
        found = F.coalesce(found, nothing)
        if keep is not None:
            found = F.filter(found, lambda s: keep[s["at"]])
        return F.transform(found, lambda s: F.struct(s["start"].alias("start"), F.lit(kind).alias("kind"), s["end"].alias("end")))

    hits_col = gaps_col = None
    out = F.transform(F.array(F.struct(hits.alias("hits"), gaps.alias("gaps"))), spans)[0]
    may = F.regexp_like(text, F.lit(pattern)) if where is None else where
    return F.when(may, out).otherwise(F.array().cast(SPANS))


def _assigned(text: Column) -> Column:
    lower = F.lower(text)
    where = reduce(lambda a, b: a | b, [lower.contains(w) for w in WORDS])
    values = F.regexp_extract_all(text, F.lit(ASSIGN), F.lit(2))
    return _located(text, ASSIGN, 0, F.transform(values, lambda v: F.char_length(v) >= LEAST_VALUE), where)


def base_spans(text: Column) -> Column:
    """Spans of the base kinds by start, then kind."""
    return F.array_sort(F.concat(_assigned(text), _located(text, ACCESS, 1, where=text.contains("AKIA")), _located(text, HEX, 2)))


def log_ratio(token: Column, ratios: Column) -> Column:
    """Mean log-likelihood ratio per pair of neighbouring characters of an ASCII token."""
    codes = F.transform(F.split(token, ""), F.ascii)
    pairs = F.sequence(F.lit(0), F.char_length(token) - 2)
    return F.transform(
        F.array(codes),
        lambda c: F.aggregate(pairs, F.lit(0.0), lambda acc, i: acc + F.get(ratios, c[i] * SYMBOLS + c[i + 1])) / (F.char_length(token) - 1),
    )[0]


def _added(text: Column, base: Column, ratios: Column) -> Column:
    token = lambda s: F.substring(text, s["start"] + 1, s["end"] - s["start"])
    least = lambda s: F.lit(THRESHOLD) * F.sqrt(F.greatest(F.lit(1.0), FULL_TOKEN / (s["end"] - s["start"])))
    apart = lambda s, others: ~F.exists(others, lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"]))
    span = lambda a, b: F.struct(a.alias("start"), F.lit(3).alias("kind"), b.alias("end"))

    def rest(s: Column) -> Column:
        """The parts of a span outside the base spans, which come by start."""
        zero = F.struct(s["start"].alias("at"), F.array().cast(SPANS).alias("out"))

        def step(acc: Column, b: Column) -> Column:
            before = F.concat(acc["out"], F.array(span(acc["at"], b["start"])))
            out = F.when(acc["at"] < b["start"], before).otherwise(acc["out"])
            return F.struct(F.greatest(acc["at"], b["end"]).alias("at"), out.alias("out"))

        hit = F.filter(base, lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"]))
        return F.aggregate(hit, zero, step, lambda acc: F.concat(acc["out"], F.array(span(acc["at"], s["end"]))))

    def mixed(s: Column) -> Column:
        return (s["end"] - s["start"] >= FULL_TOKEN) | ~F.regexp_like(token(s), F.lit(WORD))

    def scored(pattern: str) -> Column:
        parts = F.flatten(F.transform(_located(text, pattern, 3), rest))
        return F.filter(parts, lambda s: F.when(s["end"] - s["start"] >= LEAST_TOKEN, mixed(s) & (log_ratio(token(s), ratios) > least(s))).otherwise(False))

    both = F.transform(F.array(F.struct(scored(TOKEN).alias("runs"), scored(PIECE).alias("pieces"))), lambda f: F.concat(f["runs"], F.filter(f["pieces"], lambda s: apart(s, f["runs"]))))
    return both[0]


def _pairs(strings: DataFrame) -> DataFrame:
    """Counts of character pairs of a column ``s``."""
    chars = strings.filter(F.length("s") > 1).select(F.explode(F.transform(F.sequence(F.lit(1), F.length("s") - 1), lambda i: F.substring("s", i, 2))).alias("pair"))
    return chars.groupBy("pair").count()


def train(docs: DataFrame, text: str = "text", sample: int = SAMPLE_DOCS, doc: str = "doc_id") -> Column:
    """Log-ratios of character pairs as an array literal, from a sample of at most ``sample`` documents, chosen by
    the hash of id and text; no other column has a say.
    """
    spark = docs.sparkSession
    by = [c for c in (doc, text) if c in docs.columns]
    rows = docs.select(F.coalesce(F.col(text), F.lit("")).alias("text"), F.xxhash64(*by).alias("h"))
    # hashes alone choose the sample, so that no task gathers texts of the others; repeated rows are cut by the limit
    last = rows.select("h").orderBy("h").limit(sample).agg(F.max("h")).first()[0]
    rows = rows.filter(F.col("h") <= F.lit(last).cast("bigint")).limit(sample)
    rows = kept = keep(rows.withColumn("base", base_spans(F.col("text"))), "sample")  # read twice below
    value = F.transform("base", lambda s: F.regexp_extract(F.substring("text", s["start"] + 1, s["end"] - s["start"]), "[A-Za-z0-9+/_.=-]+$", 0))
    digest = F.sha2(F.col("id").cast("string"), 256)
    coded = F.base64(F.unhex(digest))
    alphabets = F.array(F.substring(digest, 1, 40), F.substring(coded, 1, 40), F.regexp_replace(coded, "[+/=]", ""), F.upper(F.translate(coded, "+/=", "")))
    random = rows.select(F.explode(value).alias("s")).unionByName(spark.range(SAMPLE_DIGESTS).select(F.explode(alphabets).alias("s")))
    blank = F.aggregate("base", F.col("text"), lambda acc, s: F.concat(F.substring(acc, F.lit(1), s["start"]), F.repeat(F.lit(" "), s["end"] - s["start"]), F.substring(acc, s["end"] + 1, F.lit(1 << 30))))
    words = rows.select(F.filter(F.split(blank, r"[^A-Za-z0-9_]+"), lambda w: F.length(w) > 1).alias("w"))
    joined = F.transform(F.sequence(F.lit(0), F.size("w") - 2), lambda i: F.array(F.concat_ws("_", F.col("w")[i], F.col("w")[i + 1]), F.concat(F.col("w")[i], F.initcap(F.col("w")[i + 1]))))
    ordinary = words.filter(F.size("w") > 1).select(F.explode(F.concat("w", F.flatten(joined))).alias("s"))
    counts = {label: {r.pair: r["count"] for r in _pairs(s).collect()} for label, s in (("random", random), ("ordinary", ordinary))}
    drop_kept(kept)
    logs = {}
    for label, seen in counts.items():  # Markov transitions with add-half smoothing over the token characters
        total = [0.0] * SYMBOLS
        known = {(ord(p[0]), ord(p[1])): n for p, n in seen.items() if len(p) == 2 and p.isascii()}
        for (a, _), n in known.items():
            total[a] += n
        logs[label] = [math.log((known.get((a, b), 0) + 0.5) / (total[a] + 33)) for a in range(SYMBOLS) for b in range(SYMBOLS)]
    trained = bool(counts["random"] and counts["ordinary"])
    ratios = [round(r - o, 4) if trained else -1.0 for r, o in zip(logs["random"], logs["ordinary"], strict=True)]
    return F.split(F.lit(",".join(map(str, ratios))), ",").cast("array<double>")  # folds to a literal


def find_secrets(docs: DataFrame, ratios: Column, *, text: str = "text", result: str = "secrets") -> DataFrame:
    """Add an array of spans ``(start, kind, end)`` by start, then kind; ``kind`` numbers :data:`KINDS`."""
    body = F.coalesce(F.col(text), F.lit(""))
    out = docs.drop(result).withColumn(result, base_spans(body))
    return out.withColumn(result, F.array_sort(F.concat(result, _added(body, F.col(result), ratios))))


def redact(docs: DataFrame, ratios: Column, *, text: str = "text", mask: str = "[SECRET]", length: str | None = None) -> DataFrame:
    """Every span of every text replaced by ``mask`` (once where spans overlap); ``length`` is a column of characters to renew."""
    mark = fresh_name(docs, "__secrets")
    found = find_secrets(docs, ratios, text=text, result=mark)
    body = F.col(text)
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(acc: Column, s: Column) -> Column:
        more = F.concat(F.substring(body, acc["at"] + 1, s["start"] - acc["at"]), F.lit(mask))
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), F.when(s["start"] >= acc["at"], F.concat(acc["out"], more)).otherwise(acc["out"]).alias("out"))

    whole = F.aggregate(mark, start, step, lambda acc: F.concat(acc["out"], F.substring(body, acc["at"] + 1, F.lit(1 << 30))))
    out = found.withColumn(text, F.when(F.size(mark) > 0, whole).otherwise(body))
    if length:
        out = out.withColumn(length, F.when(F.size(mark) > 0, F.char_length(text)).otherwise(F.col(length)).cast(docs.schema[length].dataType))
    return out.select(*docs.columns)


def _listed(spans: Column) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", names[s["kind"]], s["start"].cast("string"), s["end"].cast("string"))))


def query(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = find_secrets(docs, train(docs))
    number = lambda k: F.size(F.filter("secrets", lambda s: s["kind"] == k)).cast("bigint")
    return found.select(
        "doc_id", number(0).alias("n_assign"), number(1).alias("n_access"), number(2).alias("n_hex"),
        F.sha2(_listed(F.filter("secrets", lambda s: s["kind"] < 3)), 256).alias("base_sha256"), _listed(F.col("secrets")).alias("spans"),
    )
