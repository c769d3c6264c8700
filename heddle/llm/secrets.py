"""Secret scans: fixed patterns, and a battery of randomness tests with false-discovery control.

Base spans come from three patterns. The battery looks at every run of 20 or more characters of an encoding alphabet:

* its encoding is inferred from its characters (hexadecimal, upper-case base 36, letters, base 62 or base 64);
* uniform randomness: a chi-squared test of the alphabet's use, a runs test of its lower against its upper half, and
  a serial-correlation test of neighbours; Fisher's method combines the three p-values, and a run that fails is no key;
* written text: the sum of squared letter counts has a known mean and variance when letters are drawn as in text, both
  functions of the run's length, and how far the run lies below gives its p-value against text;
* for each encoding and length class these p-values, over all documents, go through Benjamini and Hochberg's rule in
  bins of a tenth of a power of ten (rounded up, which keeps the rate), so short runs need stronger evidence where
  the corpus is full of short words.

All of it is column expressions over whole texts. Only the bounded table of thresholds passes through the driver.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from heddle.llm.common import materialise

#: The base patterns, and substrings of a lower-cased text without which a pattern cannot match.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ASSIGN_NEEDS = ("passw", "secret", "token", "apikey", "api_key")
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
RUN = r"[A-Za-z0-9+/_-]{20,}"
KINDS = ("assign", "access", "hex", "random")
#: Encodings in the order they are tried: name, pattern, alphabet, and for text drawn from its characters the sums of
#: the squares and cubes of the letters' shares.
DIGITS, UPPER, LOWER = "0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
ENCODINGS = (
    ("decimal", "^[0-9]+$", DIGITS, 0.10, 0.010),
    ("hex", "^[0-9a-f]+$", DIGITS + "abcdef", 0.26, 0.085),
    ("HEX", "^[0-9A-F]+$", DIGITS + "ABCDEF", 0.26, 0.085),
    ("lower", "^[a-z]+$", LOWER, 0.068, 0.0063),
    ("base36", "^[A-Z0-9]+$", DIGITS + UPPER, 0.066, 0.0060),
    ("letters", "^[A-Za-z]+$", UPPER + LOWER, 0.066, 0.0060),
    ("base62", "^[A-Za-z0-9]+$", DIGITS + UPPER + LOWER, 0.064, 0.0058),
    ("base64", "^.+$", UPPER + LOWER + DIGITS + "+/", 0.062, 0.0056),
)
#: Numbers identify rather than authenticate; they are counted in no class.
NOT_KEYS = ("decimal",)
RATE, LEAST_P = 0.01, 0.001
BINS = 300


def spans_of(text: Column, pattern: str, wanted: Column, least: int = 1, group: int = 0) -> Column:
    """Leftmost non-overlapping matches as structs (start, end, token) in code points.

    Matches with a group shorter than ``least`` are dropped after matching. Where ``wanted`` is false the pattern
    cannot match and is not run.
    """
    # The text between matches and the matches themselves alternate, so their lengths give every offset.
    between, found = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    groups = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else found
    both = F.arrays_zip(F.slice(between, 1, F.size(found)).alias("gap"), found.alias("hit"), groups.alias("group"))

    def step(state: Column, x: Column) -> Column:
        start = state["at"] + F.length(x["gap"])
        end = start + F.length(x["hit"])
        one = F.struct(start.alias("start"), end.alias("end"), x["hit"].alias("token"))
        return F.struct(end.alias("at"), F.when(F.length(x["group"]) >= least, F.array_append(state["out"], one)).otherwise(state["out"]).alias("out"))

    kind = "array<struct<start:int,end:int,token:string>>"
    none = F.array().cast(kind)
    return F.when(wanted, F.aggregate(both, F.struct(F.lit(0).alias("at"), none.alias("out")), step)["out"]).otherwise(none)


def _below(z: Column) -> Column:
    """The normal distribution function, by a logistic of a cubic; within a factor of three up to five deviations."""
    return 1 / (1 + F.exp(-F.greatest(F.least(1.5976 * z + 0.070566 * z * z * z, F.lit(300.0)), F.lit(-300.0))))


def _let(value: Column, then) -> Column:
    """Names a value, so that an expression that uses it often holds it once."""
    return F.transform(F.array(value), then)[0]


def _encoding(token: Column) -> Column:
    """The first encoding whose pattern a run matches, as a struct of its name, alphabet, halves and text sums."""
    out = F.lit(None)
    for name, pattern, alphabet, s2, s3 in reversed(ENCODINGS):
        half = len(alphabet) // 2
        halves = "0" * half + "1" * (len(alphabet) - half)
        one = F.struct(F.lit(name).alias("name"), F.lit(alphabet).alias("alphabet"), F.lit(halves).alias("halves"), F.lit(s2).alias("s2"), F.lit(s3).alias("s3"))
        out = F.when(token.rlike(pattern), one).otherwise(out)
    return out


def _counted(x: Column) -> Column:
    """What the tests need of struct (token, e): length, squared counts, halves, changes and serial sums."""
    token, alphabet = x["token"], x["e"]["alphabet"]
    counts = F.transform(F.split(alphabet, ""), lambda c: (F.length(token) - F.length(F.replace(token, c, F.lit("")))).cast("double"))
    places = F.transform(F.split(token, ""), lambda c: F.instr(alphabet, c).cast("double"))

    def serial(state: Column, v: Column) -> Column:
        paired = F.when(state["last"].isNull(), F.lit(0.0)).otherwise(state["last"] * v)
        return F.struct((state["s"] + v).alias("s"), (state["q"] + v * v).alias("q"), (state["p"] + paired).alias("p"), F.coalesce(state["first"], v).alias("first"), v.alias("last"))

    zero = F.struct(F.lit(0.0).alias("s"), F.lit(0.0).alias("q"), F.lit(0.0).alias("p"), F.lit(None).cast("double").alias("first"), F.lit(None).cast("double").alias("last"))
    return F.struct(
        x["e"].alias("e"),
        F.length(token).cast("double").alias("n"),
        F.length(alphabet).cast("double").alias("size"),
        F.aggregate(counts, F.lit(0.0), lambda a, v: a + v * v).alias("squares"),
        F.call_function("translate", token, alphabet, x["e"]["halves"]).alias("bits"),
        F.aggregate(places, zero, serial).alias("serial"),
    )


def _tested(x: Column) -> Column:
    """The statistics as deviations from their means: chi-squared, runs, serial correlation, and against text."""
    n, size, bits, st = x["n"], x["size"], x["bits"], x["serial"]
    s2, s3 = x["e"]["s2"], x["e"]["s3"]
    chi = (x["squares"] * size / n - n - (size - 1)) / F.sqrt(2 * (size - 1))
    changes = 2 * F.length(bits) - F.length(F.replace(bits, F.lit("01"), F.lit("x"))) - F.length(F.replace(bits, F.lit("10"), F.lit("x")))
    ones = F.length(F.replace(bits, F.lit("0"), F.lit(""))).cast("double")
    runs = _let(2 * ones * (n - ones), lambda m: F.when(m > n, F.abs(changes - m / n) / F.sqrt(m * (m - n) / (n * n * (n - 1)))).otherwise(F.lit(9.0)))
    # Circular lag-one correlation; its mean is -1/(n-1) and its variance about 1/n.
    below = n * st["q"] - st["s"] * st["s"]
    r = (n * (st["p"] + st["first"] * st["last"]) - st["s"] * st["s"]) / below
    serial = F.when(below > 0, F.abs(r + 1 / (n - 1)) * F.sqrt(n)).otherwise(F.lit(9.0))
    spread = F.sqrt(4 * (n * (n - 1) / 2 * (s2 - s2 * s2) + n * (n - 1) * (n - 2) * (s3 - s2 * s2)))
    text = (x["squares"] - n - n * (n - 1) * s2) / spread
    return F.struct(x["e"]["name"].alias("name"), n.alias("n"), chi.alias("chi"), runs.alias("runs"), serial.alias("serial"), text.alias("text"))


def _battery(token: Column) -> Column:
    """Struct (encoding, class, bin, random) of a run: its inferred encoding, length class, bin of its p-value against
    text, and whether uniform randomness stands."""
    least = F.lit(1e-12)

    def logs(t: Column) -> Column:
        return F.ln(F.greatest(1 - _below(t["chi"]), least)) + F.ln(F.greatest(2 * _below(-t["runs"]), least)) + F.ln(F.greatest(2 * _below(-t["serial"]), least))

    def judged(t: Column) -> Column:
        bin_ = F.least(F.floor(-10 * F.log10(F.greatest(_below(t["text"]), F.lit(1e-30)))), F.lit(BINS)).cast("int")
        random = _let(logs(t), lambda g: F.exp(g) * (1 - g + g * g / 2) >= LEAST_P)
        return F.struct(t["name"].alias("encoding"), F.floor(2 * F.log2(t["n"])).cast("int").alias("class"), bin_.alias("bin"), random.alias("random"))

    named = _let(_encoding(token), lambda e: F.struct(F.when(e["name"] == "base64", F.translate(token, "-_", "+/")).otherwise(token).alias("token"), e.alias("e")))
    return _let(_let(_let(named, _counted), _tested), judged)


def thresholds(tested: DataFrame) -> DataFrame:
    """``tested(encoding, class, bin)`` -> ``(encoding, class, least)``: the least bin that the false-discovery rule accepts.

    A bin b means p <= 10^(-b/10). It is accepted when p times the number of runs is at most RATE times the number
    of runs in that bin and above. One row per encoding, class and bin enters the window.
    """
    counts = tested.groupBy("encoding", "class", "bin").count()
    group = Window.partitionBy("encoding", "class")
    sums = counts.withColumn("all", F.sum("count").over(group)).withColumn("above", F.sum("count").over(group.orderBy(F.desc("bin"))))
    return sums.where(F.pow(F.lit(10.0), -F.col("bin") / 10) * F.col("all") <= RATE * F.col("above")).groupBy("encoding", "class").agg(F.min("bin").alias("least"))


def _named(spans: Column, kind: int) -> Column:
    return F.transform(spans, lambda x: F.struct(x["start"].alias("start"), F.lit(kind).alias("kind"), x["end"].alias("end")))


def _joined(spans: Column) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.element_at(names, x["kind"] + 1), x["start"].cast("string"), x["end"].cast("string"))), ",")


def secret_spans(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, n_assign, n_access, n_hex, base, spans)`` for every row; base and spans are arrays (start, kind, end).

    base holds the pattern spans by start and kind; spans adds the battery's ``random`` spans that lie in no base
    span. Null and empty texts have none. Rows come back as often as they came in; other columns are ignored, whatever
    their names; an empty table gives an empty one.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    lower = F.lower(text)
    needs = F.lit(False)
    for x in ASSIGN_NEEDS:
        needs = needs | F.contains(lower, F.lit(x))
    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    rows = rows.select(
        "id",
        spans_of(text, ASSIGN, needs, least=6, group=2).alias("assign"),
        spans_of(text, ACCESS, F.contains(text, F.lit("AKIA"))).alias("access"),
        spans_of(text, HEX, text.rlike(HEX)).alias("hex"),
        spans_of(text, RUN, text.rlike(RUN)).alias("runs"),
    )
    tested = F.transform("runs", lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), _battery(x["token"]).alias("t")))
    rows = materialise(rows.select("id", *(F.transform(k, lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"))).alias(k) for k in KINDS[:3]), tested.alias("runs")), "secrets")
    each = rows.select(F.explode("runs.t").alias("t")).select("t.*").where(~F.col("encoding").isin(*NOT_KEYS))
    # At most one row for each encoding and length class: no more than 8 times 64.
    accepted = {f"{r['encoding']}:{r['class']}": r["least"] for r in thresholds(each).collect()}
    least = F.create_map(*(F.lit(x) for pair in accepted.items() for x in pair)) if accepted else F.lit(None).cast("map<string,int>")
    base = F.array_sort(F.concat(*(_named(F.col(k), i) for i, k in enumerate(KINDS[:3]))))

    def is_key(x: Column) -> Column:
        bound = F.try_element_at(least, F.concat_ws(":", x["t"]["encoding"], x["t"]["class"].cast("string")))
        return F.coalesce(x["t"]["random"] & (x["t"]["bin"] >= bound), F.lit(False))

    def is_new(x: Column) -> Column:
        return ~F.exists("base", lambda b: (b["start"] <= x["start"]) & (x["end"] <= b["end"]))

    rows = rows.withColumn("base", base)
    extra = _named(F.filter("runs", lambda x: is_key(x) & is_new(x)), 3)
    return rows.select("id", *(F.size(k).cast("long").alias(f"n_{k}") for k in KINDS[:3]), "base", F.array_sort(F.concat("base", extra)).alias("spans"))


def span_digest(found: DataFrame) -> DataFrame:
    """The spans as text, and the base spans' SHA-256."""
    return found.withColumn("base_sha256", F.sha2(_joined(F.col("base")).cast("binary"), 256)).withColumn("spans", _joined(F.col("spans"))).drop("base")
