"""Secret scans: fixed patterns, and sliding-window entropy over candidate strings. DataFrame functions only."""

from __future__ import annotations

import math
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The base patterns.
ASSIGN = r"""([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"

#: Entropy is measured in windows of so many characters.
WINDOW = 20
#: Kinds that the method adds: (kind, candidate strings, patterns that must all be found in one, least entropy in bits of some
#: window, the same where the string has no digit; None: such a string is no candidate). Random strings of 16, 36 and 64 kinds of
#: characters give about 3.2, 3.8 and 4.0 bits in 20 characters; words joined together about 3.3.
CLASSES = [
    ("entropy_hex", r"(?<![A-Za-z0-9])[0-9a-fA-F]{20,}(?![A-Za-z0-9])", ["[0-9]", "[a-fA-F]"], 2.8, None),
    ("entropy_lower", r"(?<![A-Za-z0-9])[0-9a-z]{20,}(?![A-Za-z0-9])", ["[0-9][a-z]", "[g-z]"], 3.4, None),
    ("entropy_upper", r"(?<![A-Za-z0-9])[0-9A-Z]{20,}(?![A-Za-z0-9])", ["[0-9][A-Z]", "[G-Z]"], 3.4, None),
    ("entropy_base64", r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}={0,2}", ["[a-z]", "[A-Z]"], 3.65, 4.0),
]
#: Candidates that are never secrets, though they look random, as (patterns all found in them, patterns not found in them):
#: identifiers of the form 8-4-4-4-12, words joined by single separators, counting or alphabet runs, sample values,
#: one character eight times. No pattern repeats a group, which Java would match by recursion.
ALLOWED = [
    ([r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$"], []),
    ([r"^/?[A-Za-z][A-Za-z/_-]*[0-9]{0,4}$", "[A-Za-z][/_-]"], ["[/_-][/_-]"]),
    ([r"(?i)01234567|abcdefgh|example|sample"], []),
    ([r"(.)\1{7}"], []),
]
ORDER = ["assign", "access", "hex", *(c[0] for c in CLASSES)]
#: Matches and spans of a text are handled so many at a time: arrays and strings that grow by one are copied, so they stay short.
CHUNK = 256


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), where value is computed once however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _chunks(items: Column) -> Column:
    """A non-empty array cut into arrays of CHUNK items."""
    last = ((F.size(items) - 1) / CHUNK).cast("int")
    return F.transform(F.sequence(F.lit(0), last), lambda c: F.slice(items, c * CHUNK + 1, F.lit(CHUNK)))


def _before(values: Column, join: Callable[[Column, Column], Column]) -> Column:
    """For every item of an array of integers, all items before it put together by join, from 0."""
    start = F.struct(F.array().cast("array<int>").alias("all"), F.lit(0).alias("at"))
    step = lambda a, x: F.struct(F.concat(a["all"], F.array(a["at"])).alias("all"), join(a["at"], x).alias("at"))
    return F.aggregate(values, start, step, lambda a: a["all"])


def _found(text: Column, pattern: str) -> Column:
    """[(match, start, end)] of all leftmost non-overlapping matches, in code points: pieces between matches give the places."""
    pieces = F.transform(F.split(text, pattern, -1), lambda p: F.length(p))
    cells = F.arrays_zip(pieces.alias("p"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("m"))
    empty = F.array().cast("array<struct<m:string,s:int,e:int>>")
    width = lambda x: x["p"] + F.coalesce(F.length(x["m"]), F.lit(0))

    def step(a: Column, x: Column) -> Column:
        s, e = a["at"] + x["p"], a["at"] + width(x)
        more = F.when(x["m"].isNotNull(), F.concat(a["all"], F.array(F.struct(x["m"].alias("m"), s.alias("s"), e.alias("e"))))).otherwise(a["all"])
        return F.struct(more.alias("all"), e.alias("at"))

    def placed(chunks: Column) -> Column:
        starts = _before(F.transform(chunks, lambda c: F.aggregate(c, F.lit(0), lambda a, x: a + width(x))), lambda a, x: a + x)
        return F.flatten(F.zip_with(chunks, starts, lambda c, at: F.aggregate(c, F.struct(empty.alias("all"), at.alias("at")), step, lambda a: a["all"])))

    return F.when(text.rlike(pattern), _let(cells, lambda x: _let(_chunks(x), placed))).otherwise(empty)


def peak_entropy(word: Column, window: int = WINDOW, enough: Column | None = None) -> Column:
    """The greatest Shannon entropy, in bits a character, of any `window` characters of a string; of a shorter string, 0.

    What enters the window and what leaves it change two counts, both taken from the window itself, and the sum of
    count * log2(count) follows: a fixed amount of work a character. Once `enough` bits are seen the rest is passed over.
    """
    term = [n * math.log2(n) if n else 0.0 for n in range(window + 2)]
    rise = F.lit([b - a for a, b in zip(term, term[1:])])  # of the sum, when a count of n grows by one
    codes = F.filter(F.transform(F.split(word, ""), lambda c: F.ascii(c)), lambda x: x > 0)
    many = lambda w, c: F.size(F.filter(w, lambda x: x == c))
    # The window starts full of characters that occur once each, so it counts when the last of those has left it.
    limit = (math.log2(window) - enough) * window if enough is not None else F.lit(-1.0)  # of the sum; computed once a string
    zero = F.struct(F.lit([-1 - k for k in range(window)]).alias("w"), F.lit(0.0).alias("s"), F.lit(math.inf).alias("least"), limit.alias("limit"))
    least = lambda a: F.when(F.get(a["w"], F.lit(0)) >= 0, F.least(a["least"], a["s"])).otherwise(a["least"])

    def step(a: Column, c: Column) -> Column:
        old = F.get(a["w"], F.lit(0))
        come = many(a["w"], c) - (old == c).cast("int")
        s = a["s"] - F.get(rise, many(a["w"], old) - 1) + F.get(rise, come)
        more = F.struct(F.concat(F.slice(a["w"], 2, window - 1), F.array(c)).alias("w"), s.alias("s"), least(a).alias("least"), a["limit"].alias("limit"))
        return F.when(a["least"] <= a["limit"], a).otherwise(more)

    return F.aggregate(codes, zero, step, lambda a: F.greatest(F.lit(0.0), math.log2(window) - least(a) / window))


def _allowed(word: Column) -> Column:
    """Whether a candidate is on the allow-list."""
    each = [reduce(lambda a, b: a & b, [word.rlike(p) for p in has] + [~word.rlike(p) for p in lacks]) for has, lacks in ALLOWED]
    return reduce(lambda a, b: a | b, each)


def _random(needs: list[str], least: float, bare: float | None) -> Callable[[Column], Column]:
    """The test of a candidate of one class: what it must hold, the allow-list, and the entropy it must reach."""

    def test(x: Column) -> Column:
        enough = F.when(x["m"].rlike("[0-9]"), F.lit(least)).otherwise(F.lit(bare)) if bare else F.lit(least)
        return reduce(lambda a, b: a & b, [x["m"].rlike(p) for p in needs]) & ~_allowed(x["m"]) & (peak_entropy(x["m"], enough=enough) >= enough)

    return test


#: The column that holds spans while a text is redacted.
SPANS = "_secret spans of this text_"


def secret_spans(column: Column) -> Column:
    """Array of (kind, start, end), ends exclusive, in code points, by start and then in the order of kinds.

    Base kinds: assign (a name, : or =, and a value of 6 or more), access, hex. The method adds entropy_hex, entropy_lower,
    entropy_upper and entropy_base64: strings of one character class in which some window of WINDOW characters has the class's entropy
    and which are not on the allow-list. Null text is empty and has none; places of equal start stand in the order of kinds.
    Texts of any length are scanned whole, each in its own row, in time in proportion to them: no shuffle.
    """
    text = F.coalesce(column.cast("string"), F.lit(""))
    kind = lambda k, f: F.transform(f, lambda x: F.struct(x["s"].alias("start"), F.lit(ORDER.index(k)).alias("rank"), x["e"].alias("end")))
    assigned = F.filter(_found(text, ASSIGN), lambda x: F.length(F.regexp_extract(x["m"], ASSIGN, 2)) >= 6)
    parts = [kind("assign", assigned), kind("access", _found(text, ACCESS)), kind("hex", _found(text, HEX))]
    for name, candidates, *rules in CLASSES:
        parts.append(kind(name, F.filter(_found(text, candidates), _random(*rules))))
    names = F.array(*(F.lit(k) for k in ORDER))
    return F.transform(F.array_sort(F.concat(*parts)), lambda x: F.struct(F.get(names, x["rank"]).alias("kind"), x["start"], x["end"]))


def found_secrets(docs: DataFrame, text_column: str = "text") -> DataFrame:
    """Adds secrets, the spans of `secret_spans`; a column of that name is replaced."""
    return docs.withColumn("secrets", secret_spans(F.col(text_column)))


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def secret_digests(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans of every document."""
    found = found_secrets(docs.select(F.col(id_column).alias("doc_id"), F.col(text_column).alias("_text")), "_text")
    count = lambda k: F.size(F.filter("secrets", lambda x: x["kind"] == k)).cast("long").alias(f"n_{k}")
    base = F.filter("secrets", lambda x: x["kind"].isin("assign", "access", "hex"))
    return found.select("doc_id", count("assign"), count("access"), count("hex"), F.sha2(_joined(base), 256).alias("base_sha256"), _joined(F.col("secrets")).alias("spans"))


def redacted(docs: DataFrame, text_column: str = "text", mark: str = "<secret>") -> DataFrame:
    """Documents with every secret span of their text replaced by a mark; overlapping spans give one mark. Null stays null."""
    found = docs.withColumn(SPANS, secret_spans(F.col(text_column)))
    text = F.col(text_column)

    def rewritten(part: Column, begin: Column, spans: Column) -> Column:
        """The piece of the text from `begin` on that a chunk of spans reaches over."""

        def step(a: Column, x: Column) -> Column:
            grown = F.concat(a["t"], F.substring(part, a["at"] - begin + 1, x["start"] - a["at"]), F.lit(mark))
            return F.struct(F.when(x["start"] >= a["at"], grown).otherwise(a["t"]).alias("t"), F.greatest(a["at"], x["end"]).alias("at"))

        return F.aggregate(spans, F.struct(F.lit("").alias("t"), begin.alias("at")), step, lambda a: a["t"])

    def cleaned(chunks: Column) -> Column:
        ends = F.transform(chunks, lambda c: F.array_max(F.transform(c, lambda x: x["end"])))

        def joined(begins: Column) -> Column:
            places = F.arrays_zip(chunks.alias("c"), begins.alias("b"), ends.alias("e"))
            parts = F.transform(places, lambda x: _let(F.substring(text, x["b"] + 1, F.greatest(x["e"] - x["b"], F.lit(0))), lambda part: rewritten(part, x["b"], x["c"])))
            return F.concat(F.array_join(parts, ""), F.substring(text, F.array_max(ends) + 1, F.length(text)))

        return _let(_before(ends, lambda a, x: F.greatest(a, x)), joined)

    clean = _let(_chunks(F.col(SPANS)), cleaned)
    return found.withColumn(text_column, F.when(F.size(SPANS) > 0, clean).otherwise(text)).drop(SPANS)
