"""Licence scan by canonical digests, in DataFrame expressions only.

A text is brought to a canonical form: lower case, copyright lines dropped,
equivalent spellings made one, punctuation and white space folded to single
spaces. The digest (SHA-256) of the whole canonical text is then joined by hash
with the digests of known licences. ``units`` says what is held against the
list: the whole document, and each of its lines, so that a licence notice that
stands on a line of its own is found too.

The digest of the whole text is joined with the list by hash. Lines are looked
up in the row: the canonical text is made once, with its line ends kept, and of
its lines' digests only those of the list are left before anything else is done
with them. That takes a list of at most ``literal_rows`` digests, which is then
also broadcast; with a longer one the rows are numbered, written, and the digests
of all units joined by a shuffle. Both give the same rows.

Null and empty texts have no units. Repeated rows are reported one by one, a
licence that a document holds twice is listed once. An empty table or list
gives no findings. Copyright lines alone are no licence. Columns that clash with
the output names are replaced.
"""

from __future__ import annotations

import re
from importlib import resources

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm.quality import let
from graphloom.llm.rows import ROW, boxed, own, quoted
from graphloom.runtime import Scratch

# Equivalent spellings, as (pattern, replacement) on lower-cased text.
SPELLINGS = [
    (r"licence", "license"),
    (r"licencing", "licensing"),
    (r"sub-license", "sublicense"),
    (r"noninfringement|non infringement", "non-infringement"),
    (r"merchantibility", "merchantability"),
    (r"copyright owner", "copyright holder"),
    (r"organisation", "organization"),
    (r"favour", "favor"),
    (r"whilst", "while"),
    (r"https://", "http://"),
]
COPYRIGHT_LINE = r"(?m)^[ \t]*(?:copyright|\(c\)|©)[^\n]*(?:\(c\)|©|[0-9]{4})[^\n]*$"

_MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_ISC = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
# Licence id, kind of text, text.
KNOWN = [
    ("MIT", "text", _MIT),
    ("MIT", "text", "MIT License\n\n" + _MIT),
    ("MIT", "text", "The MIT License (MIT)\n\n" + _MIT),
    ("ISC", "text", _ISC),
    ("ISC", "text", "ISC License\n\n" + _ISC),
    ("MIT", "notice", "Released under the MIT License."),
    ("MIT", "notice", "Licensed under the MIT License."),
    ("MIT", "notice", "This project is licensed under the MIT License."),
    ("MIT", "tag", "SPDX-License-Identifier: MIT"),
    ("Apache-2.0", "notice", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "notice", "Released under the Apache License, Version 2.0."),
    ("Apache-2.0", "tag", "SPDX-License-Identifier: Apache-2.0"),
    ("GPL-3.0", "notice", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "notice", "Licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "tag", "SPDX-License-Identifier: GPL-3.0-only"),
    ("GPL-2.0", "tag", "SPDX-License-Identifier: GPL-2.0-only"),
    ("CC-BY-NC-4.0", "notice", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "notice", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "notice", "Licensed under CC BY-SA 4.0."),
    ("CC0-1.0", "notice", "Released under CC0 1.0."),
    ("BSD-3-Clause", "notice", "Released under the BSD 3-Clause License."),
    ("BSD-2-Clause", "notice", "Released under the BSD 2-Clause License."),
    ("BSD-3-Clause", "tag", "SPDX-License-Identifier: BSD-3-Clause"),
    ("Proprietary", "notice", "All rights reserved."),
]


#: Lines before the text proper: with all of them, without the title, without any.
_HEADS = {
    "Apache-2.0": r"(?s)\A.*?(?=TERMS AND CONDITIONS FOR USE)",
    "CC0-1.0": r"(?s)\A.*?(?=Statement of Purpose)",
    "MPL-1.1": r"(?s)\A.*?(?=1\. Definitions)",
    "MPL-2.0": r"(?s)\A.*?(?=1\. Definitions)",
}
_BSD_TITLES = ["", "BSD License", "BSD {}-Clause License", "The BSD {}-Clause License", "The {}-Clause BSD License", "The BSD License", 'BSD {}-Clause "{}" License']
_ADDRESSES = ["51 Franklin Street, Fifth Floor, Boston, MA 02110-1301 USA", "51 Franklin St, Fifth Floor, Boston, MA 02110-1301 USA", "59 Temple Place, Suite 330, Boston, MA 02111-1307 USA", "675 Mass Ave, Cambridge, MA 02139, USA", "<https://fsf.org/>", ""]


def _bsd(text: str) -> list[tuple[str, str, str]]:
    three = text.split("All rights reserved.", 1)[1]
    holders = three.replace("name of the University", "name of the copyright holder").replace("THE REGENTS", "THE COPYRIGHT HOLDERS")
    bodies = [three, holders, holders.replace("SHALL THE COPYRIGHT HOLDERS", "SHALL THE COPYRIGHT HOLDER")]
    bodies.append(bodies[2].replace("Neither the name of the copyright holder nor the names of its\n   contributors", "Neither the name of the copyright holder nor the names of its contributors"))
    out = []
    for body in dict.fromkeys(bodies):
        two = re.sub(r"(?s)3\. Neither.*?permission\.\n", "", body)
        for license, size, alias, form in (("BSD-3-Clause", "3", "New", body), ("BSD-2-Clause", "2", "Simplified", two)):
            for marks in (form, re.sub(r"(?m)^[123]\. ", "* ", form)):
                for title in _BSD_TITLES:
                    for reserved in ("", "All rights reserved.\n"):
                        out.append((license, "text", "\n".join([title.replace("{}", size, 1).replace("{}", alias), reserved, marks])))
    return out


def _whole_texts() -> list[tuple[str, str, str]]:
    """Licences given as files, in the forms in which they usually stand: with or without heading, appendix and address."""
    out = []
    for file in sorted((resources.files("graphloom.llm") / "license_texts").iterdir(), key=lambda x: x.name):
        license, text = file.name.removesuffix(".txt"), file.read_text(encoding="utf-8")
        if license == "BSD-3-Clause":
            out += _bsd(text)
            continue
        forms = [text]
        if license == "Apache-2.0":
            forms.append(re.sub(r"(?m)^ *Copyright \[yyyy\].*$", "", text))
        if "END OF TERMS AND CONDITIONS" in text:
            body = text.split("END OF TERMS AND CONDITIONS", 1)[0]
            forms += [body, body + "END OF TERMS AND CONDITIONS"]
        if license == "MPL-2.0":
            forms.append(re.split(r"(?m)^Exhibit A", text)[0])
        if license.startswith(("GPL", "LGPL")):
            address = r"51 Franklin St(?:reet)?, Fifth Floor, Boston, MA\s+02110-1301,?\s+USA"
            forms += [re.sub(address, to, x, count=n) for x in forms for to in _ADDRESSES for n in (0, 1)]
            forms += [re.sub(r"(?s)\A.*?(?=Everyone is permitted)", "", x) for x in forms]
        if license == "CC0-1.0":
            forms.append(text.replace("Creative Commons Legal Code", "", 1))
            forms.append("CC0 1.0 Universal\n\n" + re.sub(_HEADS[license], "", text))
        if license in _HEADS:
            forms += [re.sub(_HEADS[license], "", x) for x in forms]
        out += [(license, "text", x) for x in dict.fromkeys(forms)]
    return out


KNOWN += _whole_texts()


def canonical_lines(text: Column) -> Column:
    """Lower-cased, without copyright lines, one spelling, words of a line apart by single spaces, line ends kept."""
    out = F.regexp_replace(F.lower(text), COPYRIGHT_LINE, " ")
    for pattern, to in SPELLINGS:
        out = F.regexp_replace(out, pattern, to)
    return F.regexp_replace(out, r"[^\p{L}\p{N}\n]+", " ")


def flat(lines: Column) -> Column:
    """A canonical text without its line ends."""
    return F.btrim(F.regexp_replace(lines, r"[ \n]+", " "))


def digest(form: Column) -> Column:
    """SHA-256 of a canonical form; null where nothing is left of it."""
    return F.when(F.length(form) > 0, F.sha2(form, 256))


def known_digests(spark: SparkSession, known: list[tuple[str, str, str]] = KNOWN) -> DataFrame:
    rows = spark.createDataFrame(known, "license string, kind string, text string")
    return rows.select(digest(flat(canonical_lines(F.col("text")))).alias("digest"), "license", "kind").where("digest is not null").groupBy("digest").agg(F.min("license").alias("license"), F.min("kind").alias("kind"))


def line_digests(lines: Column) -> Column:
    """Digests of the distinct lines of a canonical text; null for those of which nothing is left."""
    return F.transform(F.array_distinct(F.split(lines, "\n")), lambda x: digest(F.btrim(x)))


NEW = ("document_license", "license_ids", "n_licenses")


def find_licenses(df: DataFrame, known: DataFrame | None = None, text_col: str = "text", literal_rows: int = 5_000) -> DataFrame:
    """``df`` with document_license, license_ids and n_licenses in place of the text.

    document_license: of the licence that the whole text is, or null;
    license_ids: those of the whole text and its lines, sorted, comma-joined.
    ``known`` has digest and license, a row for each digest.
    """
    spark = df.sparkSession
    known = (known_digests(spark) if known is None else known).select("digest", F.col("license").alias("_license"))
    few = known.limit(literal_rows + 1).collect()
    rows = boxed(df, F.col(quoted(text_col)).alias("text"), but=(text_col, *NEW))
    if len(few) <= literal_rows:
        found = _in_row(rows, few)
    else:
        found = _by_shuffle(rows, known, Scratch(spark, "licenses"))
    ids = F.array_sort(F.array_distinct(F.filter(F.concat(F.array("_license"), "_of_lines"), lambda x: x.isNotNull())))
    named = found.select(ROW, "_license", ids.alias("_ids"))
    return named.select(*own(df, text_col, *NEW), F.col("_license").alias("document_license"), F.array_join("_ids", ",").alias("license_ids"), F.size("_ids").cast("long").alias("n_licenses"))


def _in_row(rows: DataFrame, known: list) -> DataFrame:
    """ROW, the whole text's licence, and those of its lines."""
    listed = [r.digest for r in known]
    names = F.create_map(*(F.lit(x) for r in known for x in r)) if known else F.lit(None).cast("map<string,string>")
    # A set of literals is searched by hash; the map only for what was found.
    hits = lambda of_lines: F.transform(F.filter(of_lines, lambda d: d.isin(listed)), lambda d: names[d])
    forms = rows.select(ROW, let(canonical_lines(F.col("text")), lambda x: F.struct(digest(flat(x)).alias("whole"), hits(line_digests(x)).alias("of_lines"))).alias("c"))
    table = rows.sparkSession.createDataFrame([tuple(r) for r in known], "digest string, _license string")
    named = forms.select(ROW, "c.*").join(F.broadcast(table), F.col("whole") == F.col("digest"), "left")
    return named.select(ROW, "_license", F.coalesce("of_lines", F.array().cast("array<string>")).alias("_of_lines"))


def _by_shuffle(rows: DataFrame, known: DataFrame, scratch: Scratch) -> DataFrame:
    """The same for a list of any length: the numbers of rows are written before they are used."""
    forms = rows.select(F.monotonically_increasing_id().alias("n"), ROW, let(canonical_lines(F.col("text")), lambda x: F.struct(digest(flat(x)).alias("whole"), line_digests(x).alias("of_lines"))).alias("c"))
    forms = scratch.table(forms.select("n", ROW, "c.*"), "rows")
    units = forms.select("n", F.lit(True).alias("all"), F.col("whole").alias("digest")).union(forms.select("n", F.lit(False), F.explode("of_lines"))).where("digest is not null")
    found = units.join(known, "digest").groupBy("n").agg(F.max(F.when(F.col("all"), F.col("_license"))).alias("_license"), F.collect_set("_license").alias("_of_lines"))
    return forms.select("n", ROW).join(found, "n", "left").select(ROW, "_license", F.coalesce("_of_lines", F.array().cast("array<string>")).alias("_of_lines"))
