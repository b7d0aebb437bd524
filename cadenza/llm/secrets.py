"""Secret scans with SQL functions only: fixed patterns and a battery of randomness tests.

Patterns give the base spans. The battery looks at the longer runs of key characters
outside the base spans and outside UUIDs, which name things and open none; of runs with
separators also at the parts that fit one encoding, so that a key is found behind a path,
and of signed web tokens at the signature, for which the whole token stands. It infers a
run's encoding from its characters, then tests it against uniform random symbols of that
encoding: chi-squared for the use of the alphabet, runs above and below its middle,
serial correlation of neighbours. Fisher's method joins the three p-values.

Which p-value makes a secret is a question of false discovery: words written together
also pass, the more often the shorter they are. NATURAL says how often, by length and
kind of encoding. In each stratum of encoding and length the counts over all documents
give the number of natural runs in it, and the least p-value is taken at which so many
would make up no more than FALSE_SECRETS of what is reported as of kind ``random``. Only
counts by level meet, so a bounded number of rows reaches the driver; each text is
matched once, and its spans are kept for the second step.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cadenza.llm.store import keep

# The base patterns, in the order in which kinds are listed, and least lengths.
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
ASSIGN_VALUE, ACCESS_LENGTH, HEX_LENGTH = 8, 16, 32
KINDS = ("assign", "access", "hex", "random")
# Encodings by pattern, with their symbols in order.
DIGITS, LOWER, UPPER = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
ENCODINGS = (
    ("hex", "^[0-9a-f]+$", DIGITS + "abcdef"),
    ("HEX", "^[0-9A-F]+$", DIGITS + "ABCDEF"),
    ("base32", "^[A-Z2-7]+$", UPPER + "234567"),
    ("base36", "^[0-9a-z]+$", DIGITS + LOWER),
    ("BASE36", "^[0-9A-Z]+$", DIGITS + UPPER),
    ("base62", "^[0-9A-Za-z]+$", DIGITS + LOWER + UPPER),
    ("base64", "^[0-9A-Za-z+/]+$", UPPER + LOWER + DIGITS + "+/"),
    ("base64url", "^[0-9A-Za-z_-]+$", UPPER + LOWER + DIGITS + "-_"),
)
#: Encodings whose symbols also part words.
MARKED = ("base64", "base64url")
# Least lengths of the length classes.
LENGTHS = (16, 20, 24, 28, 34, 40, 52, 64)
RUN_LENGTH = LENGTHS[0]
UUID = r"\b[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}\b"
# Header and payload of a signed web token; it and the key characters of a run.
SIGNED = r"eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+\."
RUN = rf"(?:{SIGNED})?[A-Za-z0-9+/_-]{{{RUN_LENGTH},}}"
# What stands between the parts of a run, the parts by alphabet, and a part that is a word.
SEPARATOR, WORD = "[+/_-]", "^[A-Za-z]?[a-z]{2,}$"
PARTS = tuple(rf"[A-Za-z0-9{marks}]{{{RUN_LENGTH},}}" for marks in ("+/", "_-", ""))
#: Joint p-values by level: a run of level i has one above LEVELS[i] and none before.
LEVELS = (0.5, 0.2, 0.1, 0.03, 0.01, 0.001)
# The share of natural runs with a p-value above each level, for each length
# class; measured on words of English prose and of invented languages, written together in
# lower, upper and camel case, with and without numbers (plain) and with separators
# (marked), the largest share of these kinds.
NATURAL = {
    "plain": (
        (0.273, 0.531, 0.658, 0.792, 0.867, 0.954), (0.152, 0.386, 0.528, 0.694, 0.81, 0.916), (0.092, 0.267, 0.399, 0.57, 0.684, 0.856), (0.043, 0.163, 0.269, 0.454, 0.59, 0.8),
        (0.014, 0.084, 0.151, 0.297, 0.432, 0.683), (0.007, 0.031, 0.071, 0.165, 0.263, 0.513), (0.001, 0.005, 0.013, 0.033, 0.075, 0.219), (0.001, 0.001, 0.002, 0.01, 0.018, 0.073),
    ),
    "marked": (
        (0.024, 0.124, 0.201, 0.363, 0.502, 0.716), (0.003, 0.019, 0.059, 0.144, 0.247, 0.465), (0.001, 0.005, 0.013, 0.041, 0.085, 0.23), (0.001, 0.001, 0.001, 0.009, 0.02, 0.079),
        (0.001, 0.001, 0.001, 0.001, 0.002, 0.009), *((0.001,) * 6,) * 3,
    ),
}
#: Largest expected share of natural runs in what is reported; level from which shares of random and natural runs are told.
FALSE_SECRETS, TELLING = 0.1, 2
#: Prefix sums and cuts go by blocks of so many matches and code points.
MATCHES, POINTS = 256, 4096
MASK = "[SECRET]"


def _span(start: Column, length: Column, order: int) -> Column:
    return F.struct(start.cast("int").alias("start"), F.lit(order).alias("kind"), (start + length).cast("int").alias("end"))


def _before(values: Column, join, zero: int = 0) -> Column:
    """For each of an array of numbers those before it, joined; by blocks, so that no long array is copied for each."""

    def scan(part: Column, value) -> Column:
        state = F.struct(F.lit(zero).alias("at"), F.expr("cast(array() as array<int>)").alias("out"))
        return F.aggregate(part, state, lambda s, x: F.struct(join(s["at"], value(x)).alias("at"), F.concat(s["out"], F.array(s["at"])).alias("out")))

    def joined(blocks: Column) -> Column:
        heads = scan(blocks, lambda x: x["at"])["out"]
        return F.flatten(F.transform(F.arrays_zip(blocks.alias("block"), heads.alias("head")), lambda x: F.transform(x["block"]["out"], lambda y: join(x["head"], y))))

    starts = F.sequence(F.lit(1), F.greatest(F.size(values), F.lit(1)), F.lit(MATCHES))
    return _let(F.transform(starts, lambda i: scan(F.slice(values, i, F.lit(MATCHES)), lambda x: x)), joined)


def _cut(blocks: Column, start: Column, end: Column) -> Column:
    """Code points from start to end of a text that comes in blocks of POINTS."""
    low = F.floor(start / POINTS).cast("int")
    count = F.floor((end - 1) / POINTS).cast("int") - low + 1
    own = F.array_join(F.slice(blocks, low + 1, F.greatest(count, F.lit(0))), "")
    return F.when(end > start, F.substring(own, start - low * POINTS + 1, end - start)).otherwise("")


def _replaced(text: Column, found: Column, put) -> Column:
    """The text with put(start, end, goes on) for each of its spans, sorted by start; of one that meets the one before only the rest, which goes on."""

    def pieces(v: Column) -> Column:
        blocks, ends = v["blocks"], F.transform(found, lambda x: x["end"])

        def piece(x: Column) -> Column:
            at, start, end = x["at"], x["x"]["start"], x["x"]["end"]
            fresh = F.concat(_cut(blocks, at, start), put(start, end, False))
            return F.when(end <= at, "").when(start < at, put(at, end, True)).otherwise(fresh)

        all_ = F.transform(F.arrays_zip(found.alias("x"), _before(ends, F.greatest).alias("at")), piece)
        return F.concat(F.array_join(all_, ""), _cut(blocks, F.array_max(ends), F.char_length(text)))

    blocks = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{POINTS}}}"), F.lit(0))
    return F.when(F.size(found) > 0, _let(F.struct(blocks.alias("blocks")), pieces)).otherwise(text)


def _matches(text: Column, pattern: str, group: int | None = None) -> Column:
    """Structs (start, size, body) of a pattern's matches; start in code points, body the match or a group of it."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    body = found if group is None else F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    gaps = F.transform(F.split(text, pattern, -1), F.char_length)
    sizes = F.transform(found, F.char_length)
    totals = F.transform(F.arrays_zip(gaps.alias("gap"), sizes.alias("size")), lambda x: x["gap"] + F.coalesce(x["size"], F.lit(0)))
    ends = F.arrays_zip(gaps.alias("gap"), _before(totals, lambda a, b: a + b).alias("before"))
    starts = F.slice(F.transform(ends, lambda x: x["before"] + x["gap"]), 1, F.size(sizes))
    zipped = F.arrays_zip(starts.alias("start"), sizes.alias("size"), body.alias("body"))
    empty = F.filter(F.arrays_zip(F.array(F.lit(0)).alias("start"), F.array(F.lit(0)).alias("size"), F.array(F.lit("")).alias("body")), lambda x: F.lit(False))
    return F.when(F.regexp_like(text, F.lit(pattern)), zipped).otherwise(empty)


def base_spans(text: Column) -> tuple[Column, Column, Column]:
    """Arrays of (start, kind, end) for assign, access and hex."""
    assign = F.filter(_matches(text, ASSIGN, 2), lambda x: F.char_length(x["body"]) >= ASSIGN_VALUE)
    # a run's first start has the longest match, so that runs which fail can be left out by the pattern
    access = _matches(text, ACCESS.replace("+", f"{{{ACCESS_LENGTH - 4},}}"))
    hexes = _matches(text, HEX.replace("+", f"{{{HEX_LENGTH},}}"))
    named = lambda k: lambda x: _span(x["start"], x["size"], k)
    return tuple(F.transform(m, named(k)) for k, m in enumerate((assign, access, hexes)))


def encoding(run: Column) -> Column:
    """The index of the inferred encoding, or null."""
    out = F.lit(None).cast("int")
    for k, (_, pattern, _) in reversed(list(enumerate(ENCODINGS))):
        out = F.when(run.rlike(pattern), F.lit(k)).otherwise(out)
    return out


def _let(value: Column, body) -> Column:
    """body of a value that is worked out once, however often body names it."""
    return F.transform(F.array(value), body)[0]


def _upper(z: Column) -> Column:
    """P(normal > z), by the series 26.2.17 of Abramowitz and Stegun."""

    def of(v: Column) -> Column:
        z, t = v["z"], v["t"]
        # The series' coefficients.
        series = t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
        return _let(F.exp(-z * z / 2) / 2.5066282746310002 * series, lambda tail: F.when(z >= 0, tail).otherwise(1 - tail))

    return _let(z, lambda z: _let(F.struct(z.alias("z"), (1 / (1 + 0.2316419 * F.abs(z))).alias("t")), of))


def symbols_of(kind: Column) -> Column:
    return F.element_at(F.array(*(F.lit(s) for _, _, s in ENCODINGS)), kind + 1)


def battery(run: Column, symbols: Column) -> Column:
    """Fisher's joint p-value of a run under the symbols of its encoding: small where it is not random."""

    def of(v: Column) -> Column:
        run, symbols, n, k = v["run"], v["symbols"], v["n"], v["k"]
        squares = F.aggregate(F.split(symbols, ""), F.lit(0.0), lambda s, c: s + F.when(c == "", 0.0).otherwise(F.pow(n - F.char_length(F.replace(run, c, F.lit(""))), 2.0)))
        df = k - 1
        # chi-squared to normal by cube roots (Wilson and Hilferty)
        p_chi = _upper((F.cbrt(F.greatest(k / n * squares - n, F.lit(0.0)) / df) - (1 - 2 / (9 * df))) / F.sqrt(2 / (9 * df)))
        start = F.struct(*(F.lit(0.0).alias(c) for c in ("last", "i", "high", "runs", "s", "ss", "lag")))

        def step(a: Column, c: Column) -> Column:
            def moved(x: Column) -> Column:
                turn = F.when((a["i"] == 0) | ((x > 0) != (a["last"] > 0)), 1.0).otherwise(0.0)
                return F.struct(
                    x.alias("last"), (a["i"] + 1).alias("i"), (a["high"] + F.when(x > 0, 1.0).otherwise(0.0)).alias("high"), (a["runs"] + turn).alias("runs"),
                    (a["s"] + x).alias("s"), (a["ss"] + x * x).alias("ss"), (a["lag"] + F.when(a["i"] > 0, x * a["last"]).otherwise(0.0)).alias("lag"),
                )

            return F.when(c == "", a).otherwise(_let((F.instr(symbols, c) - 1 - (k - 1) / 2).cast("double"), moved))

        def tests(a: Column) -> Column:
            mean = 2 * a["high"] * (n - a["high"]) / n + 1
            p_runs = _let(
                F.struct(mean.alias("mean"), F.sqrt((mean - 1) * (mean - 2) / (n - 1)).alias("spread")),
                lambda m: F.when(m["spread"] > 0, 2 * _upper(F.abs(a["runs"] - m["mean"]) / m["spread"])).otherwise(0.0),
            )
            square = a["s"] * a["s"] / n
            serial = F.when(a["ss"] - square > 0, (a["lag"] - square) / (a["ss"] - square)).otherwise(1.0)
            p_serial = 2 * _upper(F.abs(serial * F.sqrt(n)))
            logs = (F.log(F.greatest(p, F.lit(1e-300))) for p in (p_chi, p_runs, p_serial))
            return _let(-sum(logs, F.lit(0.0)), lambda half: F.exp(-half) * (1 + half + half * half / 2))

        return F.aggregate(F.split(run, ""), start, step, tests)

    sizes = (F.char_length(c).cast("double") for c in (run, symbols))
    return _let(F.struct(run.alias("run"), symbols.alias("symbols"), *(c.alias(n) for c, n in zip(sizes, "nk", strict=True))), of)


def _blanked(text: Column, found: Column) -> Column:
    """The text with blanks for its spans, at the same places."""
    return _replaced(text, found, lambda start, end, _: F.repeat(F.lit(" "), end - start))


def _trimmed(run: Column) -> Column:
    """The run without the words that stand before its first and after its last other part."""

    def step(a: Column, c: Column) -> Column:
        size, word = F.char_length(c), c.rlike(WORD)
        other = (size > 0) & ~word
        return F.struct(
            (a["at"] + size + 1).alias("at"),
            F.when((a["start"] < 0) & other, F.when(a["word"], a["at"]).otherwise(F.lit(0))).otherwise(a["start"]).alias("start"),
            F.when(other, a["at"] + size).otherwise(a["end"]).alias("end"),
            # whether a word has come since the start or the last other part
            F.when(other, F.lit(False)).otherwise(a["word"] | word).alias("word"),
        )

    def cut(a: Column) -> Column:
        size = F.when(a["start"] < 0, F.lit(0)).otherwise(F.when(a["word"], a["end"]).otherwise(a["at"] - 1) - a["start"])
        return F.struct((run["start"] + a["start"]).alias("start"), size.alias("size"), F.substring(run["body"], a["start"] + 1, size).alias("body"))

    start = F.struct(F.lit(0).alias("at"), F.lit(-1).alias("start"), F.lit(0).alias("end"), F.lit(False).alias("word"))
    return F.when(run["body"].rlike(SEPARATOR), F.aggregate(F.split(run["body"], SEPARATOR, -1), start, step, cut)).otherwise(run)


def _parts(run: Column) -> Column:
    """Structs (start, size, body): the run, or its parts of each alphabet; a signed token as a whole, with its signature as body."""
    moved = lambda y: F.struct((run["start"] + y["start"]).alias("start"), y["size"].alias("size"), y["body"].alias("body"))
    parts = F.concat(*(F.transform(_matches(run["body"], p), moved) for p in PARTS))
    trimmed = F.filter(F.transform(parts, _trimmed), lambda x: x["size"] >= RUN_LENGTH)
    signed = F.array(F.struct(run["start"].alias("start"), run["size"].alias("size"), F.substring_index(run["body"], ".", -1).alias("body")))
    return F.when(run["body"].contains("."), signed).when(run["body"].rlike(SEPARATOR), F.array_distinct(trimmed)).otherwise(F.array(run))


def marked(rows: DataFrame, text: Column, *columns: Column) -> DataFrame:
    """columns, with base (the base spans) and runs (for each run outside base spans and UUIDs, structs (start, size, stratum, level) of its parts that fit an encoding), written once."""
    classes = lambda n: sum(((n >= low).cast("int") for low in LENGTHS[1:]), F.lit(0))
    level = lambda p: sum(((p <= x).cast("int") for x in LEVELS), F.lit(0))
    each = lambda body: F.transform("runs", lambda run: F.transform(run, body))
    field = lambda x, *more: F.struct(x["start"].alias("start"), x["size"].alias("size"), *more)

    # one step a column: what is used in several places is worked out once
    found = rows.select(*columns, F.coalesce(text, F.lit("")).alias("rest"))
    found = found.withColumn("base", F.concat(*base_spans(F.col("rest"))))
    found = found.withColumn("rest", _blanked(F.col("rest"), F.array_sort("base")))
    found = found.withColumn("uuids", F.transform(_matches(F.col("rest"), UUID), lambda x: _span(x["start"], x["size"], 3)))
    found = found.withColumn("rest", _blanked(F.col("rest"), F.col("uuids")))
    found = found.withColumn("runs", _matches(F.col("rest"), RUN)).drop("rest", "uuids")
    found = found.withColumn("runs", F.transform("runs", _parts))
    found = found.withColumn("runs", each(lambda x: field(x, x["body"].alias("body"), encoding(x["body"]).alias("kind"))))
    # fields, so that nothing is looked up again for each character
    found = found.withColumn("runs", F.transform("runs", lambda run: F.filter(run, lambda x: x["kind"].isNotNull())))
    found = found.withColumn("runs", each(lambda x: field(x, x["body"].alias("body"), x["kind"].alias("kind"), symbols_of(x["kind"]).alias("symbols"))))
    found = found.withColumn("runs", each(lambda x: field(x, (x["kind"] * len(LENGTHS) + classes(F.char_length(x["body"]))).alias("stratum"), battery(x["body"], x["symbols"]).alias("p"))))
    return keep(found.withColumn("runs", each(lambda x: field(x, x["stratum"].alias("stratum"), level(x["p"]).alias("level")))))


def accepted(counts: dict[int, int], length: int, kind: str) -> int:
    """The last level of a stratum that is reported, or -1, from its runs by level.

    A run is natural or random: random ones have p-values spread evenly, natural ones are
    at a level as NATURAL says. That gives the natural ones among all, and one is added,
    so that a lone run needs a p-value that natural runs hardly have.
    """
    tails, n = NATURAL[kind][length], sum(counts.values())
    above = [sum(m for i, m in counts.items() if i <= level) for level in range(len(LEVELS))]
    random = (above[TELLING] - n * tails[TELLING]) / (1 - LEVELS[TELLING] - tails[TELLING])
    natural = n - min(max(random, 0), n) + 1
    return max((i for i in range(len(LEVELS)) if above[i] and natural * tails[i] <= FALSE_SECRETS * above[i]), default=-1)


def thresholds(found: DataFrame) -> dict[int, int]:
    """Stratum to its last reported level; one for each encoding and length class, and as many counts of levels, reach the driver."""
    by: dict[int, dict[int, int]] = {}
    rows = found.select(F.explode(F.flatten("runs")).alias("x")).groupBy("x.stratum", "x.level").agg(F.count(F.lit(1)).alias("n"))
    for stratum, level, n in rows.collect():
        by.setdefault(stratum, {})[level] = n
    kind = lambda s: "marked" if ENCODINGS[s // len(LENGTHS)][0] in MARKED else "plain"
    return {s: accepted(counts, s % len(LENGTHS), kind(s)) for s, counts in by.items()}


def spans(base: Column, runs: Column, limits: dict[int, int]) -> Column:
    """All spans (start, kind, end) by start and kind; random spans stand outside base spans."""
    limit = F.create_map(*(F.lit(x) for kv in (limits or {-1: -1}).items() for x in kv))
    random = lambda x: x["level"] <= F.coalesce(F.try_element_at(limit, x["stratum"]), F.lit(-1))

    def widest(found: Column) -> Column:
        holds = lambda y, x: (y["start"] <= x["start"]) & (y["end"] >= x["end"]) & (y["end"] - y["start"] > x["end"] - x["start"])
        return F.filter(found, lambda x: ~F.exists(found, lambda y: holds(y, x)))

    def added(parts: Column) -> Column:
        return _let(F.transform(F.filter(parts, random), lambda x: _span(x["start"], x["size"], 3)), widest)

    return F.array_sort(F.concat(base, F.flatten(F.transform(runs, added))))


def _named(found: Column) -> Column:
    names = F.array(*(F.lit(k) for k in KINDS))
    return F.array_join(F.transform(found, lambda x: F.concat_ws(":", F.element_at(names, x["kind"] + 1), x["start"].cast("string"), x["end"].cast("string"))), ",")


def secret_scan(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, n_assign, n_access, n_hex, base_sha256, spans (joined kind:start:end).

    Starts and ends are code points of the whole text, however long; what is done for a
    match does not grow with the matches before it. A null or empty text has no spans,
    and the digest is that of the empty string. Spans of one start come in the order of
    kinds. Repeated rows are scanned, and counted for the thresholds, each by itself; an
    empty table gives no rows; other columns are ignored.
    """
    found = marked(documents, F.col(text_col), F.col(id_col).alias("doc_id"))
    found = found.select("doc_id", spans(F.col("base"), F.col("runs"), thresholds(found)).alias("all"))
    count = lambda k: F.size(F.filter("all", lambda x: x["kind"] == k)).cast("long")
    return found.select(
        "doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"),
        F.sha2(_named(F.filter("all", lambda x: x["kind"] < 3)), 256).alias("base_sha256"), _named(F.col("all")).alias("spans"),
    )


def masked(text: Column, found: Column, mask: str = MASK) -> Column:
    """The text with its spans, merged where they overlap, replaced."""
    return _replaced(text, found, lambda start, end, goes_on: F.lit("" if goes_on else mask))


def without_secrets(documents: DataFrame, text_col: str = "text", length_col: str | None = "n_chars") -> DataFrame:
    """All rows with their secrets masked, and length_col, if there is one, made anew where the text changed.

    Null and empty texts, and all other columns, stay as they are, whatever their names.
    Repeated rows stay, masked alike; an empty table gives no rows. Texts of any length
    are masked whole.
    """
    found = marked(documents, F.col(text_col), F.struct("*").alias("row"))
    found = found.select("row", spans(F.col("base"), F.col("runs"), thresholds(found)).alias("found"))
    text = F.col(f"row.{text_col}")
    clean = F.when(F.size("found") > 0, masked(text, F.col("found"))).otherwise(text)
    out = []
    for field in documents.schema.fields:
        c = F.col(f"row.`{field.name}`")
        if field.name == text_col:
            c = clean
        elif field.name == length_col:
            c = F.when(F.size("found") > 0, F.char_length(clean).cast(field.dataType)).otherwise(c)
        out.append(c.alias(field.name))
    return found.select(*out)
