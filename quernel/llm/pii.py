"""Personal data: regular expressions propose spans, checksums confirm them, context words adjust the score. Spark's own functions only.

The patterns are possessive and look one character back, so that no text makes them backtrack or rescan a run: a match may begin inside a run only
where the match before it ended. This finds just what the plain patterns find, left to right without overlaps:

email  [A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\\.[A-Za-z0-9-]+)+
ip     [0-9]+(\\.[0-9]+)(\\.[0-9]+)(\\.[0-9]+), parts at most 255
card   [0-9]([ -]?[0-9])+, 13 to 19 digits that pass Luhn
phone  \\+[0-9][ ().0-9-]+[0-9], 9 to 15 digits

iban (mod-97), ssn and secret (shapes that count only beside a context word; a secret mixes letters and digits, and its symbols have an entropy of ENTROPY
bits at least) come on top. Context words stand within CONTEXT_CHARS before or after a match; some raise its score, others lower it, and kinds that come on top
stay only at THRESHOLD. A match that fails its check is dropped; what it covered isn't searched again.
"""

from __future__ import annotations

import string
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Pattern, score without context, words (any case) that raise it, words that lower it. A span that isn't of BASE stays at a score of THRESHOLD.
KINDS = {
    "email": (r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", 0.9, "mail|contact|write", "example"),
    "ip": (r"[0-9](?<![0-9]{2})[0-9]*+\.[0-9]++\.[0-9]++\.[0-9]++", 0.7, r"\bip\b|address|host|server|login", "version|release"),
    "card": (r"[0-9](?:[ -]?[0-9])++", 0.8, "card|visa|credit|payment|carte|karte|tarjeta", "order|tracking|serial"),
    "phone": (r"\+[0-9][ ().0-9-]+[0-9]", 0.7, r"\btel|phone|call|mobile|fax", "order|tracking|serial"),
    "iban": (r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30}(?![A-Za-z0-9])", 0.8, "iban|account|bank|konto|compte|cuenta", "tracking|serial|licen[cs]e"),
    "ssn": (r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])", 0.3, r"\bssn|social|security", "order|tracking|serial|invoice"),
    "secret": (r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}+", 0.3, "token|secret|passw|pwd|api.?key|access.?key|private.?key|auth|bearer|credential", "commit|checksum|digest|uuid|md5"),
}
BASE = ("email", "ip", "card", "phone")
THRESHOLD, CONTEXT_BONUS, CONTEXT_MALUS, CONTEXT_CHARS = 0.5, 0.3, 0.4, 40
#: Bits a symbol of a secret, and the symbols that one is made of.
ENTROPY = 3.0
SYMBOLS = string.ascii_letters + string.digits + "+/_-"
#: Matches that one fold goes over.
RUN = 128
#: A text without this can't hold a match; tested before the pattern.
NEEDS = {"email": "@", "phone": "+", "ssn": "-"}
BYTE = r"0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"


def digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """Whether a string of digits passes: from the right, every second one doubled, less 9 if over 9."""
    at = lambda i: F.substring(number, i, 1).cast("int")
    doubled = lambda i: at(i) * 2 - F.when(at(i) > 4, 9).otherwise(0)
    total = F.aggregate(F.sequence(F.lit(1), F.length(number)), F.lit(0), lambda s, i: s + F.when((F.length(number) - i) % 2 == 1, doubled(i)).otherwise(at(i)))
    return total % 10 == 0


def mod97(code: Column) -> Column:
    """Whether an IBAN passes: its first four characters moved to the end, letters as 10 to 35, the remainder by 97 is 1."""
    bare = F.replace(code, F.lit(" "))
    turned = F.concat(F.substring(bare, 5, 40), F.substring(bare, 1, 4))
    value = lambda c: F.when(c.rlike("[0-9]"), c.cast("int")).otherwise(F.ascii(c) - 55)
    step = lambda r, c: (r * F.when(c.rlike("[0-9]"), 10).otherwise(100) + value(c)) % 97
    return F.aggregate(F.split(turned, ""), F.lit(0), lambda r, c: F.when(c == "", r).otherwise(step(r, c))) == 1


def entropy(x: Column) -> Column:
    """Shannon's, in bits, of the symbols of x, all of them in SYMBOLS."""
    n = F.length(x).cast("double")
    share = lambda c: (n - F.length(F.replace(x, c, F.lit("")))) / n
    return F.aggregate(F.transform(F.array(*map(F.lit, SYMBOLS)), share), F.lit(0.0), lambda s, p: s - F.when(p > 0, p * F.log2(p)).otherwise(0.0))


def confirmed(kind: str, x: Column) -> Column:
    if kind == "ip":
        return x.rlike(rf"^{BYTE}(?:\.{BYTE}){{3}}$")
    if kind == "card":
        return F.length(digits(x)).between(13, 19) & luhn(digits(x))
    if kind == "phone":
        return F.length(digits(x)).between(9, 15)
    if kind == "iban":
        return F.length(F.replace(x, F.lit(" "))).between(15, 34) & mod97(x)
    if kind == "secret":
        return x.rlike("[0-9]") & x.rlike("[A-Za-z]") & (entropy(x) >= ENTROPY)
    return F.lit(True)


def spans_of(kind: str, text: Column, matches: Column) -> Column:
    """array<struct<kind, start, end, score>> of confirmed matches; places in code points, end exclusive."""
    pattern, score, words, against = KINDS[kind]
    # what lies between the matches gives their places
    pieces = F.split(text, pattern, -1)

    def step(found: Column, i: Column) -> Column:
        start = found["at"] + F.length(pieces_of(i))
        end = start + F.length(match_of(i))
        near = F.concat(F.right(found["before"], F.lit(CONTEXT_CHARS)), F.right(pieces_of(i), F.lit(CONTEXT_CHARS)))
        around = [F.right(near, F.lit(CONTEXT_CHARS)), F.left(i["a"], F.lit(CONTEXT_CHARS))]
        says = lambda words: reduce(lambda a, b: a | b, (x.rlike(f"(?i)(?:{words})") for x in around))
        scored = F.lit(score) + F.when(says(words), CONTEXT_BONUS).otherwise(0.0) - F.when(says(against), CONTEXT_MALUS).otherwise(0.0)
        kept = confirmed(kind, match_of(i)) & (F.lit(kind in BASE) | (scored >= THRESHOLD))
        span = F.struct(F.lit(kind).alias("kind"), start.cast("long").alias("start"), end.cast("long").alias("end"), F.least(scored, F.lit(1.0)).alias("score"))
        return F.struct(end.alias("at"), match_of(i).alias("before"), F.when(kept, F.concat(found["out"], F.array(span))).otherwise(found["out"]).alias("out"))

    match_of, pieces_of = (lambda i: i["m"]), (lambda i: i["p"])
    none = F.array().cast("array<struct<kind:string,start:bigint,end:bigint,score:double>>")
    pairs = F.arrays_zip(F.slice(pieces, F.lit(1), F.size(matches)).alias("p"), matches.alias("m"), F.slice(pieces, F.lit(2), F.size(matches)).alias("a"))

    def chunks_of(all_: Column) -> Column:
        # a fold that grows an array copies it each time, so it goes over RUN matches at most; where a chunk begins is summed up first
        chunk = lambda c: F.slice(all_, c * RUN + 1, F.lit(RUN))
        length = lambda c: F.aggregate(chunk(c), F.lit(0), lambda s, i: s + F.length(i["p"]) + F.length(i["m"]))
        numbers = F.sequence(F.lit(0), F.ceil(F.size(all_) / RUN).cast("int") - 1)
        begin = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("all"))
        starts = F.aggregate(F.transform(numbers, length), begin, lambda s, n: F.struct((s["at"] + n).alias("at"), F.concat(s["all"], F.array(s["at"])).alias("all")), lambda s: s["all"])
        before = lambda c: F.when(c > 0, F.get(all_, c * RUN - 1)["m"]).otherwise("")
        each = lambda at, c: F.aggregate(chunk(c), F.struct(at.alias("at"), before(c).alias("before"), none.alias("out")), step, lambda a: a["out"])
        return F.flatten(F.transform(starts, each))

    # bound once: a lambda works its free expressions out again at each call
    return F.flatten(F.transform(F.array(pairs), chunks_of))


def find(df: DataFrame, text: str = "text", out: str = "pii") -> DataFrame:
    """Adds out: array<struct<kind string, start long, end long, score double>>, by kind and start; it replaces a column of this name.

    Null and empty texts hold nothing. A row is judged by itself: repeated rows, ties and other columns, whatever their names, don't matter. An empty table stays empty.
    """
    said = F.coalesce(F.col(text), F.lit(""))
    none = F.array().cast("array<string>")
    found = df.drop(out)
    own = "__"
    while any(c.lower().startswith(own) for c in df.columns):
        own += "_"
    for kind, (pattern, *_) in KINDS.items():
        matches = F.regexp_extract_all(said, F.lit(pattern), F.lit(0))
        if kind in NEEDS:
            matches = F.when(said.contains(NEEDS[kind]), matches).otherwise(none)
        found = found.withColumn(own + kind, matches)
    empty = F.array().cast("array<struct<kind:string,start:bigint,end:bigint,score:double>>")
    spans = [F.when(F.size(own + kind) > 0, spans_of(kind, said, F.col(own + kind))).otherwise(empty) for kind in KINDS]
    return found.withColumn(out, F.concat(*spans)).drop(*(own + kind for kind in KINDS))


def joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and digests of the personal data in every whole text of documents."""
    found = find(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")).drop("text")
    count = lambda kind: F.size(F.filter("pii", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    extra = [kind for kind in KINDS if kind not in BASE]
    base = F.filter("pii", lambda s: reduce(lambda a, b: a | b, (s["kind"] == k for k in BASE)))
    return found.select("doc_id", *map(count, BASE), F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("pii")).alias("spans"), *map(count, extra), F.size("pii").cast("long").alias("n_spans"))
