"""Licence scan: TF-IDF cosine of lines and headers to licence templates, then inheritance along directories.

Terms are words. A term weighs by its log-damped count in a text and by rarity among all lines: 1 + ln((1 + N) /
(1 + df)), counted over every line for the words of the templates, which are few whatever the corpus; words of no
template weigh as much as the rarest. A cosine of THRESHOLD asks that the words of templates hold THRESHOLD ** 2 of a
text's squared length, whatever the template: a bound from a line's own words, without their counts, tells the lines that
can take part, and none that could is lost. Compared are those lines one by one, and runs of them with at
most one other line in between, that line's words as well: headers and whole licence texts, however they are wrapped;
two blank lines part them. A file's licence is that of its best text if the cosine reaches
THRESHOLD. A file of LICENSE_FILE's name declares the licence of its directory. A file without a licence
of its own takes that of its nearest ancestor directory that declares one.

Paths are joined by directory, not by file: distinct directories are few, and a directory with a large
share of all files is dealt apart when files look theirs up. All functions are built in.

Defined cases: null and empty texts have no licence of their own and may inherit; ties of cosine go to
the name first in order; several licence files in one directory: the path first in order; a null path
has no directory; rows with one key are one file each for their lines and share the best licence of all; a
template may have several texts; a very long text is as many rows as it has lines; columns of any names may stand
beside; an empty table gives no rows.
"""

from __future__ import annotations

from math import log

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import bounded_broadcast, fenced, lookup, stored, table

THRESHOLD, LICENSE_FILE = 0.6, r"(?i)^(licen[cs]e|copying|notice)(\.[a-z]+)?$"
#: The squared length of a template's words is this much of the others' at least.
SHARE = THRESHOLD**2 / (1 - THRESHOLD**2)

#: Public licence notices, and whole texts of short licences.
TEMPLATES = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."),
    ("BSD-2-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted under the BSD license"),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0 Creative Commons Attribution"),
    ("CC-BY-4.0", "This work is licensed under the Creative Commons Attribution 4.0 International License"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3"),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details. You should have received a copy of the GNU General Public License along with this program. If not, see <https://www.gnu.org/licenses/>."),
    ("GPL-3.0", "GNU General Public License, version 3"),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."),
    ("LGPL-3.0", "Licensed under the GNU Lesser General Public License, version 3"),
    ("LGPL-3.0", "GNU Lesser General Public License, version 3"),
    ("MIT", "Released under the MIT License"),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."),
    ("MPL-2.0", "This work is subject to the terms of the Mozilla Public License, version 2.0"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    ("Proprietary", "All rights reserved. No part may be reproduced without permission"),
]


def _words(c: Column) -> Column:
    return F.filter(F.split(F.lower(c), r"[^\p{L}\p{N}]+"), lambda x: x != "")


def own_licences(files: DataFrame, templates: DataFrame) -> DataFrame:
    """files (key, text) to (key, licence, cosine) of each file whose best line or run of lines reaches the threshold."""
    t = stored(templates.select(F.monotonically_increasing_id().alias("t"), "licence", _words(F.col("text")).alias("tw")), "templates")
    known = [r[0] for r in t.select(F.explode("tw")).distinct().collect()]  # as many as the templates have words
    array = lambda w: F.array(*map(F.lit, w)) if w else F.array().cast("array<string>")

    def lines_of(files: DataFrame) -> DataFrame:
        f = files.select(F.col("key").alias("key"), F.xxhash64("text").alias("row"), F.posexplode(F.split("text", r"\r?\n")).alias("line", "x"))
        return f.select("key", "row", "line", fenced(_words(F.col("x"))).alias("w")).where(F.size("w") > 0)

    lines = lines_of(files)
    # the counts of all lines, a row for each word of the templates; the row of an empty word counts lines
    counts = lines.select(F.explode(F.concat(F.array(F.lit("")), F.array_intersect("w", array(known)))).alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    df = {r[0]: r[1] for r in counts.collect()}
    total = df.pop("", 0)
    weights = files.sparkSession.createDataFrame([(w, df.get(w, 0)) for w in known], "term string, df bigint")
    rarest = 1 + log(1 + total)
    squares = F.create_map(*[F.lit(x) for w in known for x in (w, (1 + log((1 + total) / (1 + df.get(w, 0)))) ** 2)]) if known else F.create_map().cast("map<string,double>")
    # a template's words weigh no more than if all that repeats were one of them; others weigh once each, or more
    near = lines.select("*", fenced(F.array_intersect("w", array(known))).alias("own")).where(F.size("own") > 0)
    inside = F.size(F.filter("w", lambda x: F.array_contains("own", x)))
    most = F.aggregate("own", F.lit(0.0), lambda a, x: a + F.try_element_at(squares, x)) * F.pow(1 + F.log(inside - F.size("own") + F.lit(1.0)), 2)
    near = near.where(most >= SHARE * rarest**2 * F.size(F.array_except("w", array(known)))).drop("own")
    near = stored(near, "lines")
    w = Window.partitionBy("key", "row").orderBy("line")
    step = F.col("line") - F.lag("line").over(w)
    run = near.withColumn("step", step).withColumn("run", F.sum(F.when(F.coalesce(F.col("step") <= 2, F.lit(False)), 0).otherwise(1)).over(w))
    # the lines between two lines of a run
    gaps = stored(run.where("step = 2").select("key", "row", (F.col("line") - 1).alias("line"), "run"), "gaps")
    some = files.join(bounded_broadcast(gaps.select("key").distinct(), 500_000), "key", "left_semi")
    between = lines_of(some).join(gaps, ["key", "row", "line"]).select("key", "row", "line", "w", "run").dropDuplicates(["key", "row", "line"])
    run = run.select("key", "row", "line", "w", "run").unionByName(between)
    run = run.groupBy("key", "row", "run").agg(F.flatten(F.transform(F.sort_array(F.collect_set(F.struct("line", "w"))), lambda x: x.w)).alias("w"))
    units = near.select("key", F.concat_ws(":", F.lit("line"), "row", "line").alias("unit"), "w").unionByName(run.select("key", F.concat_ws(":", F.lit("run"), "row", "run").alias("unit"), "w"))
    idf = 1 + F.log((1 + F.lit(total)) / (1 + F.coalesce("df", F.lit(0))))
    weight = (1 + F.log("n")) * idf

    def weighed(d: DataFrame, keys: list[str], name: str) -> DataFrame:
        terms = d.groupBy(*keys, "term").agg(F.count("*").alias("n"))
        return terms.join(F.broadcast(weights), "term", "left").select(*keys, "term", weight.alias(name))

    a = weighed(units.dropDuplicates(["key", "unit"]).select("key", "unit", F.explode("w").alias("term")), ["key", "unit"], "aw")
    b = weighed(t.select("t", "licence", F.explode("tw").alias("term")), ["t", "licence"], "bw")
    b = F.broadcast(b.join(b.groupBy("t").agg(F.sqrt(F.sum(F.col("bw") * F.col("bw"))).alias("bn")), "t"))  # as many rows as the templates have words
    norm = a.groupBy("key", "unit").agg(F.sqrt(F.sum(F.col("aw") * F.col("aw"))).alias("an"))
    dot = a.join(b, "term").groupBy("key", "unit", "t", "licence").agg(F.sum(F.col("aw") * F.col("bw")).alias("dot"), F.first("bn").alias("bn"))
    cos = dot.join(norm, ["key", "unit"]).select("key", "licence", F.round(F.col("dot") / (F.col("an") * F.col("bn")), 6).alias("cosine")).where(F.col("cosine") >= THRESHOLD)
    best = cos.groupBy("key").agg(F.min(F.struct((-F.col("cosine")).alias("c"), "licence")).alias("b"))
    return best.select("key", F.col("b.licence").alias("licence"), (-F.col("b.c")).alias("cosine"))


def _parent(path: Column) -> Column:
    return F.when(F.contains(path, F.lit("/")), F.regexp_replace(path, "/[^/]*$", "")).otherwise(F.when(path.isNotNull(), ""))


def inherited(files: DataFrame) -> DataFrame:
    """files (key, path, licence) with `inherited`: of the nearest ancestor directory that declares a licence."""
    f = files.withColumn("dir", _parent(F.col("path")))
    declares = F.element_at(F.split("path", "/"), -1).rlike(LICENSE_FILE) & F.col("licence").isNotNull()
    given = f.where(declares).groupBy("dir").agg(F.min_by("licence", "path").alias("given"))
    dirs = f.where("dir is not null").groupBy("dir").agg(F.count("*").alias("c"))
    parts = F.split("dir", "/")
    up = F.explode(F.concat(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, 1, k), "/")), F.array(F.lit(""))))
    near = dirs.select("dir", "c", up.alias("above")).join(given.withColumnRenamed("dir", "above"), "above")
    near = near.groupBy("dir").agg(F.max_by("given", F.length("above")).alias("inherited"), F.first("c").alias("c"))
    return lookup(f, near, ["dir"], "c").drop("dir")


def scan(files: DataFrame, templates: DataFrame) -> DataFrame:
    """files (key, path, text) to (key, own, cosine, licence): the licence found in the file, and the one that holds."""
    own = stored(own_licences(files.select("key", "text"), templates), "own").withColumn("c", F.lit(1).cast("bigint"))
    f = lookup(files.select("key", "path"), own, ["key"], "c")
    out = inherited(f)
    return out.select("key", F.col("licence").alias("own"), "cosine", F.coalesce("licence", "inherited").alias("licence"))


def op6_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents as a tree source / lang / two digits / file. In each directory of digits and in each of a language,
    the first licensed document below is its licence file; others without a licence look up to the nearest."""
    d = table(spark, sf_dir, "documents")
    t = spark.range(1).select(F.inline(F.array(*[F.struct(F.lit(n).alias("licence"), F.lit(x).alias("text")) for n, x in TEMPLATES])))
    own = stored(own_licences(d.select(F.col("doc_id").alias("key"), "text"), t), "own")
    place = d.select(F.col("doc_id").alias("key"), F.concat_ws("/", "source", "lang").alias("up"), F.concat_ws("/", "source", "lang", (F.col("doc_id") % 41).cast("string")).alias("at"))
    found = own.select("key").join(place, "key")
    up = found.groupBy("up").agg(F.min("key").alias("key")).select("key", F.concat_ws("/", "up", F.lit("LICENSE")).alias("file"))
    at = found.join(up.select("key"), "key", "left_anti").groupBy("at").agg(F.min("key").alias("key")).select("key", F.concat_ws("/", "at", F.lit("LICENSE")).alias("file"))
    files = lookup(place, stored(up.unionByName(at), "files").withColumn("c", F.lit(1).cast("bigint")), ["key"], "c")
    files = files.select("key", F.coalesce("file", F.concat_ws("/", "at", F.lit("deep"), F.col("key").cast("string"))).alias("path"))
    f = lookup(files, own.withColumn("c", F.lit(1).cast("bigint")), ["key"], "c")
    out = inherited(f)
    return out.select(F.col("key").alias("doc_id"), F.col("licence").alias("own_licence"), "cosine", F.coalesce("licence", "inherited").alias("licence"))


_T = ", ".join(f"({k}, '{n}', '{t}')" for k, (n, t) in enumerate(TEMPLATES))
_W = r"list_filter(regexp_split_to_array(lower(x), '[^\p{L}\p{N}]+'), lambda z: z <> '')"
SQL = f"""with t0(t, licence, x) as (values {_T}), t as (select t, licence, {_W} as w from t0),
known as (select distinct unnest(w) as term from t),
l0 as (select doc_id, unnest(regexp_split_to_array(text, '\r?\n')) as x, generate_subscripts(regexp_split_to_array(text, '\r?\n'), 1) as line from documents),
l1 as (select * from (select doc_id, line, {_W} as w from l0) where len(w) > 0),
total as (select count(*) as total from l1),
df as (select known.term, count(x.doc_id) as df from known left join (select distinct doc_id, line, unnest(w) as term from l1) x on x.term = known.term group by known.term),
wt as (select term, 1 + ln((1 + total) / (1 + df)) as idf from df, total),
lt as (select doc_id, line, term, count(*) as n from (select doc_id, line, unnest(w) as term from l1) group by all),
c as (select doc_id, line, sum(idf * idf) as sq, sum(n) filter (idf is not null) as inside, count(idf) as own, count(*) - count(idf) as outside from lt left join wt using (term) group by doc_id, line),
near as (select l1.* from l1 join c using (doc_id, line), total where own > 0 and sq * power(1 + ln(inside - own + 1.0), 2) >= {SHARE} * power(1 + ln(1 + total), 2) * outside),
runs as (select *, sum(new) over (partition by doc_id order by line) as run from (select *, line - lag(line) over (partition by doc_id order by line) as step, case when step <= 2 then 0 else 1 end as new from near)),
full_runs as (select doc_id, line, w, run from runs union all select l1.doc_id, l1.line, l1.w, run from l1 join runs on runs.doc_id = l1.doc_id and runs.line = l1.line + 1 and step = 2),
units as (select doc_id, 'l' || line as unit, w from near union all select doc_id, 'r' || run, flatten(list(w order by line)) from full_runs group by doc_id, run),
a as (select doc_id, unit, term, (1 + ln(n)) * coalesce(idf, 1 + ln(1 + total)) as w from (select doc_id, unit, term, count(*) as n from (select doc_id, unit, unnest(w) as term from units) group by all) left join wt using (term), total),
b as (select t, licence, term, (1 + ln(n)) * idf as w from (select t, licence, term, count(*) as n from (select t, licence, unnest(w) as term from t) group by all) join wt using (term)),
an as (select doc_id, unit, sqrt(sum(w * w)) as n from a group by all), bn as (select t, sqrt(sum(w * w)) as n from b group by t),
cos as (select a.doc_id, licence, round(sum(a.w * b.w) / (any_value(an.n) * any_value(bn.n)), 6) as cosine from a join b using (term) join an on an.doc_id = a.doc_id and an.unit = a.unit join bn using (t) group by a.doc_id, a.unit, t, licence),
own as (select * from (select *, row_number() over (partition by doc_id order by cosine desc, licence) as r from cos where cosine >= {THRESHOLD}) where r = 1),
d as (select doc_id, source, lang, doc_id % 41 as part, own.licence as own, cosine from documents left join own using (doc_id)),
up as (select source, lang, min(doc_id) as first, arg_min(own, doc_id) as up from d where own is not null group by source, lang),
dig as (select source, lang, part, arg_min(own, doc_id) as near from d where own is not null and doc_id not in (select first from up) group by all)
select doc_id, own as own_licence, cosine, coalesce(own, near, up) as licence from d left join up using (source, lang) left join dig using (source, lang, part)"""
