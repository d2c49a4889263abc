"""License scans: MinHash bands over overlapping windows retrieve templates, exact shingle containment verifies them.

Texts and templates are lower-cased words of letters and digits; their shingles are pairs of neighbouring words.
Templates of over ``CHUNK`` words are cut into chunks of that many words. Chunks fall into classes by length; a class of chunks
of up to n words is looked for in windows of 2 n words every n words, so that a chunk lies whole in some window. Each
window and chunk has ``bands`` bands of one minimum each. A chunk that holds the share c of its m shingles in a window of w
shingles collides in a band with probability c m / w at least; the number of bands is the smallest that makes the
probability of a miss at most ``miss`` for the class's shortest chunk, at the containment asked for.

A window that holds the share c of a chunk's m shingles lacks m - c m of them at most, so it holds one of any m - c m + 1; the ones with the most
letters, which are rare, are the chunk's signature. It also has as many of the templates' shingles as the class's shortest chunk needs.
Bands are computed for windows that have both only; no match is lost by that. Shingles are known by one bit of a bitmap, a literal of the
plan: one look-up a shingle, whatever the number of templates; a bit that is set by chance only makes another window a candidate. Templates that contain each other to that share are a family (versions of one
license); of a family only the best contained counts in a window and its two neighbours, which share its text.

Only DataFrame functions are used. The templates are a parameter; their bands are broadcast, bounded by ``MAX_ROWS``.

Defined cases: a null or empty text has no match; texts are read whole; rows alike in id and text are reported once; a null id
is reported as null; an empty table gives an empty table; other columns are ignored.
"""
import json
import math
import re

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rostrum.llm._spark import Scratch

_WARRANTY = (
    "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of "
    "MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the {0} for more details. You should have received a copy of the {0} along with this program. If not, see "
    "<https://www.gnu.org/licenses/>."
)
_GNU = "This program is free software: you can redistribute it and/or modify it under the terms of the {0} as published by the Free Software Foundation, either version {1} of the License, or (at your option) any later version. "
_BSD = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
    "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
    "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. "
)
_THIRD = "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. "
_BSD_END = (
    "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND "
    "FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES "
    "(INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, "
    "STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)
#: Notices by which works name their license: short ones in one sentence, and the licenses' own headers, conditions and grants.
TEMPLATES = {
    "agpl-3.0": "This work is licensed under the GNU Affero General Public License, version 3.",
    "agpl-3.0-header": _GNU.format("GNU Affero General Public License", 3) + _WARRANTY.format("GNU Affero General Public License"),
    "apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "apache-2.0-header": (
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at "
        "http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, "
        "WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."
    ),
    "boost-1.0": "Distributed under the Boost Software License, Version 1.0. (See accompanying file LICENSE_1_0.txt or copy at https://www.boost.org/LICENSE_1_0.txt)",
    "bsd-2-clause-text": _BSD + _BSD_END,
    "bsd-3-clause": "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
    "bsd-3-clause-text": _BSD + _THIRD + _BSD_END,
    "cc-by-4.0": "Licensed under CC BY 4.0.",
    "cc-by-4.0-notice": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "cc-by-nc-4.0": "Licensed under CC BY-NC 4.0.",
    "cc-by-nc-4.0-notice": "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    "cc-by-sa-4.0": "Licensed under CC BY-SA 4.0.",
    "cc-by-sa-4.0-notice": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "cc0-1.0": "Released under CC0 1.0 Universal.",
    "gpl-2.0": "This work is licensed under the GNU General Public License, version 2.",
    "gpl-2.0-header": _GNU.format("GNU General Public License", 2) + _WARRANTY.format("GNU General Public License"),
    "gpl-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "gpl-3.0-header": _GNU.format("GNU General Public License", 3) + _WARRANTY.format("GNU General Public License"),
    "isc-text": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. "
        "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS."
    ),
    "lgpl-2.1-header": _GNU.format("GNU Lesser General Public License", "2.1") + _WARRANTY.format("GNU Lesser General Public License"),
    "lgpl-3.0": "This work is licensed under the GNU Lesser General Public License, version 3.",
    "lgpl-3.0-header": _GNU.format("GNU Lesser General Public License", 3) + _WARRANTY.format("GNU Lesser General Public License"),
    "mit": "Released under the MIT License.",
    "mit-grant": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so.",
    "mit-warranty": (
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, "
        "INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER "
        "LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
    ),
    "mpl-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "mpl-2.0-header": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    "unlicense": "This is free and unencumbered software released into the public domain.",
    "unlicense-text": "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
}
CHUNK, MAX_ROWS = 32, 1 << 20
#: Bits of a bitmap for each of its shingles: of the templates', and of the signatures', of which every word of the corpus is asked.
BITS, SIGNED = 16, 1024
WORDS = r"[^\p{L}\p{N}]+"


def _words(text: str) -> list[str]:
    return [w for w in re.split(r"[\W_]+", text.lower()) if w]


def families(cut: list, containment: float) -> list[int]:
    """For each chunk the first chunk of its class that it is linked with, directly or through others."""
    sets = [set(zip(w, w[1:])) for *_, w in cut]
    own = list(range(len(cut)))
    for i in range(len(cut)):
        for j in range(i):
            if cut[i][2] == cut[j][2] and len(sets[i] & sets[j]) >= containment * min(len(sets[i]), len(sets[j])):
                a, b = own[i], own[j]
                own = [min(a, b) if x in (a, b) else x for x in own]
    return own


def chunks(templates: dict[str, str]) -> list[tuple[str, int, int, list[str]]]:
    """(license, chunk, its class's longest length, its words); templates of one word have no shingle and raise an error."""
    out = []
    for name, text in sorted(templates.items()):
        words = _words(text)
        if len(words) < 2:
            raise ValueError(f"the template of {name} has fewer than two words")
        n = -(-len(words) // CHUNK)
        for i in range(n):
            start = min(i * CHUNK, max(0, len(words) - CHUNK))
            own = words[start : start + CHUNK]
            out.append((name, i, 1 << max(2, (len(own) - 1).bit_length()), own))
    return out


def bands_for(shortest: int, longest: int, containment: float, miss: float) -> int:
    p = containment * (shortest - 1) / (2 * longest - 1)
    return math.ceil(math.log(miss) / math.log(1 - p))


def _once(df: DataFrame, **columns) -> DataFrame:
    """``df`` with columns that are computed once a row: as a one-row generator, which filters are not pushed through."""
    return df.select("*", F.inline(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))))


def _shingled(rows: DataFrame) -> DataFrame:
    rows = _once(rows, w=F.split(F.trim(F.regexp_replace(F.lower("text"), WORDS, " ")), " ")).drop("text").where("size(w) > 1")
    return _once(rows, sh=F.expr("zip_with(slice(w, 1, size(w) - 1), slice(w, 2, size(w) - 1), (a, b) -> xxhash64(a, b))")).drop("w")


def _bitmap(hashes: set[int], bits: int):
    """Whether a hash may be one of these: a function of a column, over a literal of ``bits`` bits a hash, 2 ** 23 at most."""
    size = 1 << min(23, max(12, (bits * len(hashes) - 1).bit_length()))
    words = [0] * (size // 32)
    for h in hashes:
        words[h % size // 32] |= 1 << (h % 32)
    literal = F.from_json(F.lit(json.dumps(words)), "array<bigint>")

    def may(h):
        at = F.pmod(h, F.lit(size)).cast("int")
        return F.getbit(F.get(literal, F.shiftright(at, 5)), at.bitwiseAND(31)) == 1

    return may


def _bands(col: str, bands: int):
    return F.expr(f"transform(sequence(0, {bands - 1}), i -> array_min(transform({col}, h -> xxhash64(i, h))))")


def scan(docs: DataFrame, templates: dict[str, str] = TEMPLATES, containment: float = 0.85, miss: float = 1e-4) -> DataFrame:
    """doc_id, license, n_windows (that match), first_word (of the first such window), containment (the best), chunk_share."""
    spark = docs.sparkSession
    scratch = Scratch(spark)
    cut = chunks(templates)
    rows = docs.selectExpr("xxhash64(doc_id is null, doc_id, text) row_key", "cast(doc_id as bigint) doc_id", "cast(text as string) text")
    made = spark.createDataFrame([(n, i, c, f, " ".join(w)) for (n, i, c, w), f in zip(cut, families(cut, containment))], "license string, chunk int, longest int, family int, text string")
    made = scratch.save(_shingled(made).withColumn("sh", F.array_distinct("sh")).coalesce(1))
    every, signed = set(), set()
    for r in made.select("license", "chunk", "sh").collect():  # the templates', which the driver has given
        words = next(w for n, i, _, w in cut if (n, i) == (r.license, r.chunk))
        pairs = list(dict.fromkeys(zip(words, words[1:])))  # as the distinct hashes stand
        lacks = len(pairs) - math.ceil(containment * len(pairs))
        every |= set(r.sh)
        signed |= {h for _, h in sorted(zip(pairs, r.sh), key=lambda x: (-len("".join(x[0])), x[0]))[: lacks + 1]}
    may, sign = _bitmap(every, BITS), _bitmap(signed, SIGNED)

    # The shingles that a window must have of the templates': by class, for its shortest chunk.
    need = {c: math.ceil(containment * min(len(set(zip(w, w[1:]))) for _, _, k, w in cut if k == c)) for c in sorted({c for _, _, c, _ in cut})}
    places = lambda known: F.filter(F.sequence(F.lit(0), F.size("sh") - 1), lambda i: known(F.get("sh", i)))
    hits = _once(_shingled(rows), sig=places(sign)).where("size(sig) > 0")
    hits = _once(hits, at=places(may)).where(F.size("at") >= min(need.values()))

    def windows(n: int) -> str:
        """Those that have enough, by number; window j has the shingles from j * n to j * n + 2 * n - 2."""
        touched = f"array_distinct(flatten(transform(sig, p -> array(p div {n}, greatest(p div {n} - 1, 0L)))))"
        return f"filter({touched}, j -> size(filter(at, p -> p >= j * {n} and p < j * {n} + {2 * n - 1})) >= {need[n]})"

    hits = _once(hits, **{f"win{n}": F.expr(windows(n)) for n in need})
    hits = scratch.save(hits.where(" or ".join(f"size(win{n}) > 0" for n in need)))

    matches = None
    for longest in need:
        bands = bands_for(min(len(w) for _, _, c, w in cut if c == longest), longest, containment, miss)
        if bands * len(cut) > MAX_ROWS:
            raise ValueError("the templates' bands are too many to broadcast")
        own = made.where(F.col("longest") == longest)
        keys = own.select("license", "chunk", "family", F.col("sh").alias("tsh"), F.posexplode(_bands("sh", bands)).alias("band", "low"))
        win = hits.select("row_key", "doc_id", "sh", F.explode(f"win{longest}").alias("win"))
        win = win.withColumn("ws", F.expr(f"array_distinct(slice(sh, cast(win * {longest} + 1 as int), {2 * longest - 1}))")).drop("sh").where("size(ws) > 0")
        met = win.withColumn("low", _bands("ws", bands)).select("row_key", "doc_id", "win", "ws", F.posexplode("low").alias("band", "low"))
        met = met.join(F.broadcast(keys), ["band", "low"])
        share = F.size(F.array_intersect("ws", "tsh")) / F.size("tsh")
        met = met.withColumn("share", share).where(F.col("share") >= containment)
        met = met.groupBy("row_key", "doc_id", "win", "family", "license", "chunk").agg(F.max("share").alias("share"))
        near = Window.partitionBy("row_key", "doc_id", "family").orderBy("win").rangeBetween(-1, 1)
        top = met.withColumn("best", F.max("share").over(near)).where("share = best")
        top = top.select("row_key", "doc_id", (F.col("win") * longest).alias("word"), "license", "chunk", "share")
        matches = top if matches is None else matches.unionByName(top)
    per = {n: sum(1 for m, *_ in cut if m == n) for n, *_ in cut}
    total = F.create_map(*[F.lit(x) for kv in sorted(per.items()) for x in kv])
    out = matches.groupBy("row_key", "doc_id", "license").agg(F.count_distinct("word").alias("n_windows"), F.min("word").alias("first_word"), F.max("share").alias("containment"), F.count_distinct("chunk").alias("found"))
    return out.select("doc_id", "license", "n_windows", "first_word", "containment", (F.col("found") / total[F.col("license")]).alias("chunk_share"))


def op3_license_scan(spark, sf_dir: str) -> DataFrame:
    return scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def _sql() -> str:
    cut = chunks(TEMPLATES)
    rows = ", ".join("('%s', %d, %d, %d, %d, '%s')" % (n, i, c, f, sum(1 for m, *_ in cut if m == n), " ".join(w)) for (n, i, c, w), f in zip(cut, families(cut, 0.85)))
    return rf"""
WITH t(license, chunk, longest, family, n_chunks, words) AS (VALUES {rows}),
tw AS (SELECT *, string_split(words, ' ') AS w FROM t),
tp AS (SELECT *, unnest(range(1, len(w))) AS i FROM tw),
ts AS (SELECT DISTINCT license, chunk, longest, family, n_chunks, w[i] || ' ' || w[i + 1] AS g FROM tp),
tn AS (SELECT license, chunk, count(*) AS m FROM ts GROUP BY ALL),
d AS (SELECT doc_id, list_filter(string_split(regexp_replace(lower(text), '[^\p{{L}}\p{{N}}]+', ' ', 'g'), ' '), lambda x: x <> '') AS w FROM documents),
dp AS (SELECT doc_id, w, unnest(range(1, len(w))) AS i FROM d WHERE len(w) > 1),
ds AS (SELECT doc_id, i - 1 AS p, w[i] || ' ' || w[i + 1] AS g FROM dp),
hit AS (SELECT doc_id, license, chunk, longest, family, n_chunks, p, g FROM ds JOIN ts USING (g)),
win AS (
  SELECT *, p // longest - k AS win FROM hit, (VALUES (0), (1)) s(k)
  WHERE p // longest - k >= 0 AND p - (p // longest - k) * longest < 2 * longest - 1),
share AS (
  SELECT doc_id, win, license, chunk, longest, family, n_chunks, CAST(count(DISTINCT g) AS DOUBLE) / m AS share
  FROM win JOIN tn USING (license, chunk) GROUP BY doc_id, win, license, chunk, longest, family, n_chunks, m
  HAVING count(DISTINCT g) / m >= 0.85),
top AS (SELECT * FROM share QUALIFY share = max(share) OVER (PARTITION BY doc_id, family ORDER BY win RANGE BETWEEN 1 PRECEDING AND 1 FOLLOWING))
SELECT doc_id, license, count(DISTINCT win * longest) AS n_windows, min(win * longest) AS first_word, max(share) AS containment,
       CAST(count(DISTINCT chunk) AS DOUBLE) / n_chunks AS chunk_share
FROM top GROUP BY doc_id, license, n_chunks
"""


OP3_SQL = _sql()
