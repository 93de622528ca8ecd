"""License scans: canonical digests of entire texts, hash-joined to digests of known licences."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import small

#: Spellings that the matching guidelines for licence texts call equivalent, as (words, canonical word).
EQUIVALENT = (
    ("licence", "license"), ("licenced", "licensed"), ("licences", "licenses"), ("sublicence", "sublicense"),
    ("acknowledgment", "acknowledgement"), ("analog", "analogue"), ("analyze", "analyse"), ("artifact", "artefact"),
    ("authorization", "authorisation"), ("authorized", "authorised"), ("caliber", "calibre"), ("canceled", "cancelled"),
    ("capitalizations", "capitalisations"), ("catalog", "catalogue"), ("categorize", "categorise"), ("center", "centre"),
    ("emphasized", "emphasised"), ("favor", "favour"), ("favorite", "favourite"), ("fulfill", "fulfil"),
    ("fulfillment", "fulfilment"), ("initialize", "initialise"), ("judgment", "judgement"), ("labeling", "labelling"),
    ("labor", "labour"), ("maximize", "maximise"), ("modeled", "modelled"), ("modeling", "modelling"),
    ("noncommercial", "non commercial"), ("optimize", "optimise"), ("organization", "organisation"), ("organize", "organise"),
    ("percent", "per cent"), ("practice", "practise"), ("program", "programme"), ("realize", "realise"),
    ("recognize", "recognise"), ("signaling", "signalling"), ("subdirectory", "sub directory"), ("utilization", "utilisation"),
    ("while", "whilst"), ("wilfull", "wilful"), ("https", "http"),
)

#: Notices and one-line statements. Whole licences are the files in licenses/; more come in by an argument.
NOTICES = (
    ("Apache-2.0-notice", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at\n\nhttp://www.apache.org/licenses/LICENSE-2.0\n\nUnless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.'),
    ("GPL-3.0-or-later-notice", 'This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.\n\nThis program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.\n\nYou should have received a copy of the GNU General Public License along with this program. If not, see <https://www.gnu.org/licenses/>.'),
    ("WTFPL-terms", "DO WHAT THE FUCK YOU WANT TO PUBLIC LICENSE TERMS AND CONDITIONS FOR COPYING, DISTRIBUTION AND MODIFICATION\n\n0. You just DO WHAT THE FUCK YOU WANT TO."),
    ("Apache-2.0-line", "Licensed under the Apache License, Version 2.0."),
    ("CC-BY-NC-4.0-line", "Licensed under CC BY-NC 4.0."),
    ("GPL-3.0-line", "This work is licensed under the GNU General Public License, version 3."),
    ("MIT-line", "Released under the MIT License."),
)

#: Title lines that stand before the terms of these licences as often as not.
TITLES = {
    "MIT": ("MIT License", "The MIT License", "The MIT License (MIT)"),
    "ISC": ("ISC License", "The ISC License"),
    "0BSD": ("BSD Zero Clause License", "Zero-Clause BSD"),
    "MIT-0": ("MIT No Attribution",),
    "BSD-2-Clause": ("BSD 2-Clause License", "The 2-Clause BSD License", "Simplified BSD License"),
    "BSD-3-Clause": ("BSD 3-Clause License", "The 3-Clause BSD License", "New BSD License"),
    "Zlib": ("zlib License", "The zlib/libpng License"),
    "Unlicense": ("The Unlicense",),
    "BSL-1.0": ("Boost Software License 1.0",),
}

#: Lines that only say who holds the copyright; patterns that Java's and DuckDB's engines read alike.
COPYRIGHT_LINE = r"(?m)^[^\p{L}\p{N}\n]*(\([cC]\)|©|[cC][oO][pP][yY][rR][iI][gG][hH][tT][^\p{L}\p{N}\n]*(\([cC]\)|©|[0-9]{4}|<|\[)|[aA][lL][lL] [rR][iI][gG][hH][tT][sS] [rR][eE][sS][eE][rR][vV][eE][dD])[^\n]*$"
NOT_WORD = r"[^\p{L}\p{N}]+"


def known_licenses() -> tuple[tuple[str, str], ...]:
    """(license_id, text): the files in licenses/, each also behind its usual title lines, and NOTICES."""
    files = [(p.stem, p.read_text(encoding="utf-8")) for p in sorted((Path(__file__).parent / "licenses").glob("*.txt"))]
    titled = [(name, f"{title}\n\n{text}") for name, text in files for title in TITLES.get(name, ())]
    return (*files, *titled, *NOTICES)


def canonical(text: Column) -> Column:
    """Normal form of a text: no copyright lines, lower case, one space for anything but letters and digits, one spelling.

    The words are split once and each is looked up, so a spelling counts wherever it stands.
    """
    c = F.regexp_replace(F.coalesce(text, F.lit("")), COPYRIGHT_LINE, "")
    one = F.create_map(*(F.lit(x) for pair in EQUIVALENT for x in pair))
    words = F.filter(F.split(F.lower(c), NOT_WORD), lambda w: w != "")
    return F.array_join(F.transform(words, lambda w: F.coalesce(F.try_element_at(one, w), w)), " ")


def license_table(spark: SparkSession, licenses: tuple[tuple[str, str], ...] | None = None) -> DataFrame:
    """(license_id, digest) of known texts, by default known_licenses(); of two licences with one normal form the first name in order stays."""
    known = spark.createDataFrame([(str(k), v) for k, v in (known_licenses() if licenses is None else licenses)], "license_id string, text string")
    return known.select("license_id", F.sha2(canonical(F.col("text")), 256).alias("digest")).groupBy("digest").agg(F.min("license_id").alias("license_id"))


def license_scan(docs: DataFrame, known: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, digest, n_canonical, license_id): a row for each row; license_id is null where the entire text is no known licence.

    known: (license_id, digest). It is broadcast only if its counted rows stay within the bound, else both sides are
    dealt by digest. Null and empty texts have the digest of the empty text and no licence. Repeated rows give repeated
    rows, null ids stay null, other columns are left out, an empty table gives no rows. Native expressions only.
    """
    form = canonical(F.col(text_col))
    texts = docs.select(F.col(id_col).alias(id_col), form.alias("__form")).select(id_col, F.sha2("__form", 256).alias("digest"), F.length("__form").cast("long").alias("n_canonical"))
    side, _ = small(known.select(F.col("digest").alias("__digest"), "license_id"))
    return texts.join(side, (F.col("digest") == F.col("__digest")) & (F.col("n_canonical") > 0), "left").select(id_col, "digest", "n_canonical", "license_id")


def _sql_form(text: str) -> str:
    words = f"list_filter(string_split_regex(lower(regexp_replace(coalesce({text}, ''), '{COPYRIGHT_LINE}', '', 'g')), '{NOT_WORD}'), lambda w: w <> '')"
    spell = " ".join(f"when '{other}' then '{one}'" for other, one in EQUIVALENT)
    return f"coalesce(list_aggregate(list_transform({words}, lambda w: case w {spell} else w end), 'string_agg', ' '), '')"


def scan_sql() -> str:
    """The same over `documents` for DuckDB."""
    known = ", ".join("('{}', '{}')".format(k, v.replace("'", "''")) for k, v in known_licenses())
    return f"""
with known(license_id, text) as (values {known}),
digests as (select sha256(form) as digest, min(license_id) as license_id from (select license_id, {_sql_form("text")} as form from known) group by 1),
forms as (select doc_id, {_sql_form("text")} as form from documents)
select doc_id, sha256(form) as digest, cast(length(form) as bigint) as n_canonical, license_id
from forms left join digests on digests.digest = sha256(form) and form <> ''"""
