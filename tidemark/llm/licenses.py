"""License scans: canonical text, digest, hash join with the digests of known licences and notices. DataFrame functions only."""

from __future__ import annotations

from collections.abc import Callable
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Words that licence matching takes as the same, each spelling and what stands for it.
SPELLINGS = [
    ("licence", "license"), ("licenced", "licensed"), ("licencing", "licensing"), ("licences", "licenses"), ("sub license", "sublicense"), ("sub licence", "sublicense"), ("sublicence", "sublicense"),
    ("non commercial", "noncommercial"), ("per cent", "percent"), ("copyright owner", "copyright holder"), ("copyright owners", "copyright holders"), ("acknowledgement", "acknowledgment"),
    ("judgement", "judgment"), ("fulfil", "fulfill"), ("favour", "favor"), ("organisation", "organization"), ("recognised", "recognized"), ("whilst", "while"), ("wilful", "willful"), ("https", "http"),
]

# The licence texts in licence_texts, one file each, named by its SPDX identifier, and these notices.
APACHE_NOTICE = """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at
http://www.apache.org/licenses/LICENSE-2.0
Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."""
MPL_NOTICE = """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."""

NOTICES = [
    ("Apache-2.0", APACHE_NOTICE),
    ("MPL-2.0", MPL_NOTICE),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Apache License, Version 2.0"),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("GPL-3.0-only", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-2.0-only", "This work is licensed under the GNU General Public License, version 2."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("LicenseRef-all-rights-reserved", "All rights reserved."),
]
#: What may stand before a licence's text: nothing, its name, or a title in use.
TITLES = {"MIT": ["MIT License", "The MIT License", "The MIT License (MIT)"], "ISC": ["ISC License", "The ISC License"], "BSD-2-Clause": ["BSD 2-Clause License"], "BSD-3-Clause": ["BSD 3-Clause License"], "Zlib": ["zlib License"], "MIT-0": ["MIT No Attribution"]}


def licence_texts() -> list[tuple[str, str, str]]:
    """(licence, kind, text) of the known licences, each alone, under its titles, and with the "All rights reserved." that BSD licences carry."""
    out = []
    for path in sorted((Path(__file__).parent / "licence_texts").glob("*.txt")):
        text = path.read_text(encoding="utf-8")
        starts = [""] + [f"{t}\n" for t in TITLES.get(path.stem, [])]
        starts += [f"{t}All rights reserved.\n" for t in starts] if path.stem.startswith("BSD-") else []
        out += [(path.stem, "license", start + text) for start in starts]
    return out


#: Known texts: (licence, kind, text). A caller may give more; the table must stay small enough to broadcast, see `scanned`.
KNOWN = licence_texts()
KNOWN += [(name, "notice", text) for name, text in NOTICES] + [(name, "notice", f"SPDX-License-Identifier: {name}") for name in dict.fromkeys(x[0] for x in KNOWN)]
#: Most known texts that one scan takes, so that the broadcast table has a bound.
MOST = 100_000


#: Spellings but those that one pattern covers.
OTHERS = [x for x in SPELLINGS if not x[0].startswith("licen")]


def canonical_lines(text: Column) -> Column:
    """The canonical lines of a text: lower case, no copyright lines, words between single spaces, one spelling; empty ones dropped."""
    lower = F.lower(F.coalesce(text, F.lit("")))
    line = r"(?m)^[^\p{L}\p{N}\n]*(?:copyright|\(c\)|©)(?:[^\p{L}\p{N}\n]+(?:\(c\)|©|[0-9])|[^\p{L}\n]*[0-9]{4})[^\n]*$"
    bare = F.when(lower.rlike(r"copyright|\(c\)|©"), F.regexp_replace(lower, line, "")).otherwise(lower)
    flat = F.regexp_replace(bare, r"[^\p{L}\p{N}\n]+", " ")
    spelt = flat
    for found, stands in OTHERS:
        spelt = F.regexp_replace(spelt, rf"\b{found}\b", stands)
    spelt = F.regexp_replace(spelt, r"licenc(e|es|ed|ing|ee|ees|or|ors)\b", "licens$1")
    # Few texts have a word that is spelt in another way: the others are looked through once.
    some = r"\b(?:" + "|".join(x for x, _ in OTHERS) + r")\b|licenc(?:e|es|ed|ing|ee|ees|or|ors)\b"
    one = F.when(flat.rlike(some), spelt).otherwise(flat)
    return F.filter(F.transform(F.split(one, "\n"), lambda x: F.trim(x)), lambda x: x != "")


def _digest(line: Column) -> Column:
    return F.sha2(line, 256)


def known_digests(spark: SparkSession, known: list[tuple[str, str, str]] | None = None) -> DataFrame:
    """digest, license, kind, n_lines, n_chars of known texts; of texts with one canonical form the first counts."""
    rows = spark.createDataFrame([(k, *x) for k, x in enumerate(KNOWN if known is None else known)], "k int, license string, kind string, text string")
    whole = F.array_join(canonical_lines(F.col("text")), " ")
    rows = rows.select("k", "license", "kind", F.size(canonical_lines(F.col("text"))).alias("n_lines"), whole.alias("canon")).where("canon <> ''")
    first = rows.groupBy(_digest(F.col("canon")).alias("digest")).agg(F.min(F.struct("k", "license", "kind", "n_lines")).alias("x"), F.first(F.length("canon")).alias("n_chars"))
    return first.select("digest", "x.license", "x.kind", "x.n_lines", "n_chars")


def _runs(lines: Column, height: int, made: Callable[[Column], Column]) -> Column:
    """made(text) of every `height` lines in a row; none of fewer lines."""
    last = F.greatest(F.size(lines) - (height - 1), F.lit(0))
    places = F.filter(F.sequence(F.lit(0), last), lambda i: i > 0)
    return F.transform(places, lambda i: made(F.array_join(F.slice(lines, i, F.lit(height)), " ")))


def scanned(docs: DataFrame, known: list[tuple[str, str, str]] | None = None, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Documents that are, or have lines that are, a known licence text: doc_id, license, n_notices, notices.

    license is the licence whose canonical text the document's whole text equals (null: none); notices lists, in order and once
    each, the licences of which a line, or as many lines in a row as a known notice has, is a known text. A text is taken to its
    canonical form once; only units as long as some known one are digested, which no match can miss. The known table is of
    checked size (at most MOST rows) and is broadcast; the documents are not shuffled but for the few units that match. Null and empty
    texts match nothing; texts of any length are taken whole; of known texts with one canonical form the first counts.
    Every row is a document and answered by itself, rows that repeat a doc_id or have none too.
    """
    table = known_digests(docs.sparkSession, known)
    texts = KNOWN if known is None else known
    if len(texts) > MOST:
        raise ValueError(f"{len(texts)} known texts; at most {MOST} can be broadcast")
    sizes = table.select("n_chars", "kind", "n_lines").distinct().collect()  # at most one for each known text
    lengths, heights = sorted({r[0] for r in sizes}), sorted({r[2] for r in sizes if r[1] == "notice"} | {1})
    lines = docs.select(F.monotonically_increasing_id().alias("_row"), F.col(id_column).cast("long").alias("doc_id"), canonical_lines(F.col(text_column).cast("string")).alias("_lines"))
    unit = lambda whole, text: F.struct(F.lit(whole).alias("whole"), text.alias("unit"))
    sets = [F.array(unit(True, F.array_join("_lines", " "))), F.transform("_lines", lambda x: unit(False, x))]
    sets += [_runs(F.col("_lines"), height, lambda x: unit(False, x)) for height in heights[1:]]
    fits = F.filter(F.concat(*sets), lambda x: F.length(x["unit"]).isin(lengths or [-1]))
    units = lines.select("_row", "doc_id", F.explode(fits).alias("u")).select("_row", "doc_id", "u.whole", _digest(F.col("u.unit")).alias("digest"))
    found = units.join(F.broadcast(table), "digest")
    license_ = F.min(F.when(F.col("whole"), F.col("license")))
    notices = F.array_sort(F.collect_set(F.when(~F.col("whole"), F.col("license"))))
    made = found.groupBy("_row", "doc_id").agg(license_.alias("license"), F.sum(F.when(~F.col("whole"), 1).otherwise(0)).alias("n_notices"), F.array_join(notices, ",").alias("notices"))
    return made.drop("_row")
