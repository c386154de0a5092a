"""License scans: MinHash bands over overlapping text windows retrieve notice templates.

A text is cut into overlapping windows of ``WINDOW`` word shingles in steps of half
that, a template into overlapping segments of at most half a window, so every
occurrence of a segment lies wholly in some window.  Windows and segments that agree
in one of ``BANDS`` one-row MinHash bands are compared.  Each band has a hash function of its own,
under which every shingle of a window is as likely the least, so a segment of eight shingles
goes unseen with a chance of 2 ** -32.  Templates of fewer than ``FEW`` shingles have no such
segment, so texts with any of their shingles are compared.  The template is then verified by exact
containment of its shingles in the text.

A band can only agree if the window holds the very shingle that is a segment's minimum;
windows without any such shingle need no signature, and the outcome is the same.  A bitmap of the
templates' shingles passes over the texts that hold none.  All of it is Column expressions
and joins with the table of templates.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .textkit import let

#: Words of a shingle, shingles of a window, one-row bands.
WIDTH = 3
WINDOW = 16
BANDS = 32
#: Notices of fewer shingles than this can go unseen in the bands; any of their shingles brings them up.
FEW = 8
#: Log of the bits of the bitmap of shingles, and most shingles of all templates together (bounds what is broadcast).
BITMAP = 20
MOST = 1_000_000

_MIT = (
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), "
    "to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell "
    "copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: "
    "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. "
    "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, "
    "FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, "
    "WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
)
_ISC = (
    "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, "
    "provided that the above copyright notice and this permission notice appear in all copies. "
    "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. "
    "IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, "
    "WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
)
_BSD = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
    "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
    "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation "
    "and/or other materials provided with the distribution. "
)
_BSD_THIRD = (
    "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software "
    "without specific prior written permission. "
)
_BSD_END = (
    "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, "
    "THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS "
    "BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE "
    "GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT "
    "LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)
_APACHE = (
    "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. "
    "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software "
    "distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. "
    "See the License for the specific language governing permissions and limitations under the License."
)
_GPL = (
    "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by "
    "the Free Software Foundation, either version 3 of the License, or (at your option) any later version. "
    "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or "
    "FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details. "
    "You should have received a copy of the GNU General Public License along with this program."
)
_ZLIB = (
    "This software is provided as-is, without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. "
    "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: "
    "1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, "
    "an acknowledgment in the product documentation would be appreciated but is not required. "
    "2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. "
    "3. This notice may not be removed or altered from any source distribution."
)
_UNLICENSE = (
    "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, "
    "either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."
)

#: Well-known license notices, short grants and full short licenses (fixed values, without apostrophes).
NOTICES = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3"),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2"),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3"),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("MIT", "Licensed under the MIT License"),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    ("CC-BY-4.0", "Licensed under CC BY 4.0"),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0"),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work"),
    ("Proprietary", "All rights reserved. No part of this work may be reproduced"),
    ("MIT", "Released under the MIT License"),
    ("MIT", "Distributed under the MIT License"),
    ("MIT", "Available under the MIT License"),
    ("MIT", "This project is licensed under the terms of the MIT License"),
    ("MIT", "SPDX-License-Identifier: MIT"),
    ("Proprietary", "All rights reserved"),
    ("Apache-2.0", "Released under the Apache License, Version 2.0"),
    ("Apache-2.0", "Licensed under the Apache License 2.0"),
    ("Apache-2.0", "Released under the Apache License 2.0"),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("GPL-3.0", "under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License"),
    ("GPL-2.0", "under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License"),
    ("LGPL-3.0", "under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License"),
    ("AGPL-3.0", "under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License"),
    ("GPL-3.0", "Released under the GNU General Public License, version 3"),
    ("GPL-2.0", "Released under the GNU General Public License, version 2"),
    ("GPL-3.0", "SPDX-License-Identifier: GPL-3.0"),
    ("GPL-2.0", "SPDX-License-Identifier: GPL-2.0"),
    ("LGPL-3.0", "SPDX-License-Identifier: LGPL-3.0"),
    ("AGPL-3.0", "SPDX-License-Identifier: AGPL-3.0"),
    ("MPL-2.0", "SPDX-License-Identifier: MPL-2.0"),
    ("BSD-3-Clause", "SPDX-License-Identifier: BSD-3-Clause"),
    ("BSD-2-Clause", "SPDX-License-Identifier: BSD-2-Clause"),
    ("ISC", "SPDX-License-Identifier: ISC"),
    ("BSD-3-Clause", "Released under the BSD 3-Clause License"),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License"),
    ("BSD-2-Clause", "Licensed under the BSD 2-Clause License"),
    ("CC-BY-4.0", "licensed under a Creative Commons Attribution 4.0 International License"),
    ("CC-BY-SA-4.0", "licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"),
    ("CC-BY-NC-4.0", "licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"),
    ("CC-BY-4.0", "Released under CC BY 4.0"),
    ("CC-BY-SA-4.0", "Released under CC BY-SA 4.0"),
    ("CC-BY-NC-4.0", "Released under CC BY-NC 4.0"),
    ("Unlicense", "This is free and unencumbered software released into the public domain"),
    ("MIT", _MIT),
    ("ISC", _ISC),
    ("BSD-2-Clause", _BSD + _BSD_END),
    ("BSD-3-Clause", _BSD + _BSD_THIRD + _BSD_END),
    ("Apache-2.0", _APACHE),
    ("GPL-3.0", _GPL),
    ("Zlib", _ZLIB),
    ("Unlicense", _UNLICENSE),
]


def words(text: Column) -> Column:
    """Words of letters and digits, in lower case."""
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def shingles(ws: Column) -> Column:
    """Hashes of the windows of ``WIDTH`` words in order; of the whole if there are fewer."""

    def windows(held: Column) -> Column:
        starts = F.slice(held, 1, F.greatest(F.size(held) - (WIDTH - 1), F.lit(1)))
        return F.transform(starts, lambda w, i: F.xxhash64(w, *[F.get(held, i + k) for k in range(1, WIDTH)]))

    return let(ws, lambda held: F.when(F.size(held) > 0, windows(held)).otherwise(F.array().cast("array<bigint>")))


def _ranked(hashes: Column, band: Column | int) -> Column:
    """The hashes with their ranks in a band before them."""
    return F.transform(hashes, lambda h: F.struct(F.xxhash64(h, F.lit(band) if isinstance(band, int) else band).alias("rank"), h.alias("shingle")))


def bands(hashes: Column) -> Column:
    """Band keys of a set of shingles: hashes of the band's number and the least rank in it."""
    return F.transform(F.sequence(F.lit(1), F.lit(BANDS)), lambda i: F.xxhash64(i, F.array_min(F.transform(hashes, lambda h: F.xxhash64(h, i)))))


def minima(hashes: Column) -> Column:
    """The shingles of a set that are the minimum of each band."""
    return F.transform(F.sequence(F.lit(1), F.lit(BANDS)), lambda i: F.array_min(_ranked(hashes, i))["shingle"])


def _numbers(values: Iterable[int], in_order: bool = True) -> Column:
    """A constant array; one literal, which Spark folds, however long."""
    return F.split(F.lit(",".join(map(str, sorted(values) if in_order else values))), ",").cast("array<bigint>")


def _cut(hashes: Column, length: int, step: int) -> Column:
    last = F.greatest(F.ceil((F.size(hashes) - length) / step).cast("int"), F.lit(0))
    return F.transform(F.sequence(F.lit(0), last), lambda k: F.slice(hashes, k * step + 1, length))


def template_table(spark: SparkSession, notices: list[tuple[str, str]] | None = None) -> DataFrame:
    """``license, template, text`` of the notices."""
    rows = [(name, k, text) for k, (name, text) in enumerate(NOTICES if notices is None else notices)]
    return spark.createDataFrame(rows, "license string, template int, text string")


def scan(docs: DataFrame, templates: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: float = 0.95) -> DataFrame:
    """Pairs of a document and a notice of whose shingles it holds ``least`` or more.

    Gives the id, ``template``, ``license``, ``n_shared`` and ``n_template`` shingles and the
    ``containment``.  ``templates`` is a list of notices of at most ``MOST`` shingles together: its
    shingles and its bands, 32 for each segment of some 8 words, are read on the driver and sent to the
    executors; a longer list raises an error.  The documents are read once; of
    those that hold a template's shingle the shingles they share with templates are shuffled.

    Null, empty and blank texts and templates match nothing.  A text or template of fewer
    words than a shingle is one shingle.  Rows with a null id are scanned too; repeated rows give
    repeated pairs.  Empty tables give an empty result.  Further columns are ignored.
    """
    spark = docs.sparkSession
    half = WINDOW // 2
    listed = templates.select("template", "license", F.array_distinct(shingles(words(F.col("text")))).alias("_all")).where(F.size("_all") > 0)
    if (listed.agg(F.sum(F.size("_all"))).first()[0] or 0) > MOST:
        raise ValueError(f"the templates have more than {MOST:,} shingles; scan for parts of them")
    known = listed.cache()
    segments = known.select("template", F.explode(_cut(F.col("_all"), half, half // 2)).alias("seg"))
    marked = segments.select("template", F.explode(F.arrays_zip(minima(F.col("seg")).alias("shingle"), bands(F.col("seg")).alias("band"))).alias("x"))
    rows = marked.select("template", "x.shingle", "x.band").distinct().collect()
    every = known.collect()
    known.unpersist()
    kind = dict(docs.dtypes)[id_col]
    if not rows:
        return spark.createDataFrame([], f"{id_col} {kind}, template int, license string, n_shared long, n_template long, containment double")
    sought = {x for r in every for x in r["_all"]}
    few = [(x, r["template"]) for r in every if len(r["_all"]) < FEW for x in r["_all"]]
    by_key = spark.createDataFrame([*((r["band"], r["template"], True) for r in rows), *((x, t, False) for x, t in few)], "key long, template int, of_band boolean")
    table = spark.createDataFrame([(r["template"], r["license"], r["_all"]) for r in every], "template int, license string, _all array<long>")

    bits = [0] * (1 << BITMAP - 6)
    for x in sought:
        place = x & (1 << BITMAP) - 1
        bits[place >> 6] |= 1 << (place & 63)
    bitmap = _numbers([b - (1 << 64) if b >> 63 else b for b in bits], in_order=False)

    def maybe(h: Column) -> Column:
        place = h.bitwiseAND(F.lit((1 << BITMAP) - 1))
        return F.getbit(F.get(bitmap, F.shiftright(place, 6).cast("int")), place.bitwiseAND(F.lit(63)).cast("int")) == 1

    base = docs.select(F.col(id_col), shingles(words(F.col(text_col).cast("string"))).alias("_s"))
    seen = base.withColumn("_maybe", F.array_distinct(F.filter("_s", maybe))).where(F.size("_maybe") > 0)
    held = seen.withColumn("_held", F.array_intersect("_maybe", _numbers(sought))).where(F.size("_held") > 0)
    anchored = held.withColumn("_anchors", F.array_intersect("_held", _numbers({r["shingle"] for r in rows})))
    # signatures of the windows that hold an anchor
    windows = F.filter(_cut(F.col("_s"), WINDOW, half), lambda w: F.arrays_overlap(w, F.col("_anchors")))
    signed = F.when(F.size("_anchors") > 0, F.flatten(F.transform(windows, bands))).otherwise(F.array().cast("array<bigint>"))
    keys = F.concat(F.transform(F.array_distinct(signed), lambda k: F.struct(k.alias("key"), F.lit(True).alias("of_band"))), F.transform("_held", lambda k: F.struct(k.alias("key"), F.lit(False).alias("of_band"))))
    asked = anchored.select(id_col, "_held", F.monotonically_increasing_id().alias("_row"), keys.alias("_keys")).select(id_col, "_held", "_row", F.explode("_keys").alias("_k"))
    met = asked.select(id_col, "_held", "_row", "_k.key", "_k.of_band").join(F.broadcast(by_key), ["key", "of_band"]).dropDuplicates(["_row", "template"])
    pairs = met.join(F.broadcast(table), "template").withColumn("n_shared", F.size(F.array_intersect("_held", "_all")).cast("long")).withColumn("n_template", F.size("_all").cast("long"))
    return pairs.select(id_col, "template", "license", "n_shared", "n_template", (F.col("n_shared") / F.col("n_template")).alias("containment")).where(F.col("containment") >= least)
