"""Operator 6: licence scans by diagonal voting.

Every rolling word k-gram of a text that some template has is joined to the template's positions of
it; (position in the text - position in the template) is the diagonal, and each match votes for its
own. A phrase stands where its diagonal has all its votes: that is exact. A notice stands where a
single diagonal has the share of votes that is asked for. Besides, diagonals close to each other are
merged (a changed, missing or added word shifts the rest by a little): of them, parts whose template
ranges do not overlap are taken, the heaviest first or in template order, whichever gives more, as long
as the span is not much longer than the template; their share of the template is the score. Relatives share most of their
words, so grams that hold a telling word (a version, or what names the member of a family) must all be there: a word put
between them, or another version, makes another licence. Where notices overlap, only the best stays.

Defined results: a null text counts as empty: no words, no places, empty labels, score 0; repeated
rows each give a row; extra columns are ignored; an empty table gives none.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarry.llm.common import written
from quarry.llm.grams import positions

# Base phrases and their labels.
PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}
# Public licence notices and the labels that the method adds.
NOTICES = {
    "licensed under the apache license version 2 0": "apache-2.0",
    "released under the mit license": "mit",
    "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files": "mit",
    "this work is licensed under the gnu general public license version 3": "gpl-3.0",
    "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation": "gpl",
    "you can redistribute it and or modify it under the terms of the gnu lesser general public license": "lgpl",
    "gnu affero general public license": "agpl",
    "licensed under cc by nc 4 0": "cc-by-nc-4.0",
    "this work is licensed under a creative commons attribution 4 0 international license": "cc-by-4.0",
    "this work is licensed under a creative commons attribution sharealike 4 0 international license": "cc-by-sa-4.0",
    "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met": "bsd",
    "this source code form is subject to the terms of the mozilla public license v 2 0": "mpl-2.0",
    "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted": "isc",
    "this is free and unencumbered software released into the public domain": "unlicense",
    "all rights reserved": "all-rights-reserved",
    "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0 unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied see the license for the specific language governing permissions and limitations under the license": "apache-2.0",
    "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software": "mit",
    "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution": "bsd",
    "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose see the gnu general public license for more details": "gpl",
}
# Families of licences. Each member is named by its own short template, so a relative of one is never taken for it.
CREATIVE_COMMONS = {"nc": "noncommercial", "sa": "sharealike", "nd": "noderivatives"}
for _parts in ((), ("nc",), ("sa",), ("nd",), ("nc", "sa"), ("nc", "nd")):
    for _v in "234":
        _label = "-".join(("cc-by", *_parts, f"{_v}.0"))
        NOTICES[" ".join(("creative commons attribution", *(CREATIVE_COMMONS[x] for x in _parts), _v, "0"))] = _label
        NOTICES[" ".join(("cc by", *_parts, _v, "0"))] = _label
NOTICES |= {
    "gnu general public license version 2": "gpl-2.0",
    "gnu general public license version 3": "gpl-3.0",
    "gnu lesser general public license version 2 1": "lgpl-2.1",
    "gnu lesser general public license version 3": "lgpl-3.0",
    "gnu library general public license version 2": "lgpl-2.0",
    "gnu affero general public license version 3": "agpl-3.0",
    "apache software license version 1 1": "apache-1.1",
    "apache license version 2 0": "apache-2.0",
    "bsd 2 clause": "bsd-2-clause",
    "bsd 3 clause": "bsd-3-clause",
    "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission": "bsd-3-clause",
    "mozilla public license version 1 1": "mpl-1.1",
    "mozilla public license version 2 0": "mpl-2.0",
}
#: Words that tell a licence from its relatives, besides numbers: a notice stands only where all of its grams with such a word do.
TELLING = frozenset({"gnu", "lesser", "library", "affero", *CREATIVE_COMMONS, *CREATIVE_COMMONS.values()})
#: Words of a gram; the share of a template's grams asked for; diagonals so near are one band; spans are compared by blocks of so many words.
GRAM, SHARE, NEAR = 2, 0.8, 3
LONGEST = max(len(t.split(" ")) for t in NOTICES) * 3 // 2 + NEAR


def templates(spark: SparkSession) -> DataFrame:
    """tid, kind (phrase or notice), label, length, size, tpos, g, tells: all k-grams of all templates. Fixed size."""
    rows = []
    for kind, given in (("phrase", PHRASES), ("notice", NOTICES)):
        for text, label in given.items():
            w = text.split(" ")
            grams = [w[i : i + GRAM] for i in range(len(w) - GRAM + 1)]
            tells = [int(any(x.isdigit() or x in TELLING for x in g)) for g in grams]
            rows += [(f"{kind} {text}", kind, label, len(w), sum(tells), GRAM, i, " ".join(g), t) for i, (g, t) in enumerate(zip(grams, tells))]
    return spark.createDataFrame(rows, "tid string, kind string, label string, length int, telling int, size int, tpos int, g string, tells int")


def license_spans(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """rows (rid, doc_id, n_words) and spans (rid, kind, label, start, stop, score): verified places."""
    known = templates(docs.sparkSession)
    rows, matches = positions(docs, known, "licences")
    votes = matches.join(F.broadcast(known), ["size", "g"]).withColumn("diagonal", F.col("pos") - F.col("tpos"))
    diagonals = votes.groupBy("rid", "tid", "kind", "label", "length", "telling", "diagonal").agg(F.count("*").alias("votes"), F.sum("tells").alias("told"), F.min("pos").alias("first"), F.max("pos").alias("last"), F.min("tpos").alias("t_first"), F.max("tpos").alias("t_last"))
    need = F.col("length") - GRAM + 1
    phrases = diagonals.where("kind = 'phrase'").where(F.col("votes") == need).select("rid", "kind", "label", F.col("diagonal").alias("start"), (F.col("diagonal") + F.col("length") - 1).alias("stop"), F.lit(1.0).alias("score"))
    order = Window.partitionBy("rid", "tid").orderBy("diagonal")
    apart = F.coalesce((F.col("diagonal") - F.lag("diagonal").over(order) > NEAR).cast("int"), F.lit(1))
    bands = diagonals.where("kind = 'notice'").withColumn("band", apart).withColumn("band", F.sum("band").over(order))
    whole = diagonals.where("kind = 'notice'").where((F.col("votes") / need >= SHARE) & (F.col("told") == F.col("telling"))).select("rid", "tid", "kind", "label", F.col("first").alias("start"), (F.col("last") + GRAM - 1).alias("stop"), F.col("votes").alias("n"), (F.col("votes") / need).alias("score"))
    part = F.struct("votes", "told", "t_first", "t_last", "first", (F.col("last") + GRAM - 1).alias("stop"))
    merged = bands.groupBy("rid", "tid", "kind", "label", "length", "telling", "band").agg(F.collect_list(part).alias("parts")).where(F.size("parts") > 1)
    fits = f"not exists(s.taken, c -> x.t_first <= c.b and x.t_last >= c.a) and greatest(s.stop, x.stop) - least(s.start, x.first) + 1 <= length * 1.5 + {NEAR}"
    none = "named_struct('n', 0L, 'told', 0L, 'start', parts[0].first * 0 + 2147483647, 'stop', parts[0].stop * 0 - 1, 'taken', cast(array() as array<struct<a:int,b:int>>))"
    more = "named_struct('n', s.n + x.votes, 'told', s.told + x.told, 'start', least(s.start, x.first), 'stop', greatest(s.stop, x.stop), 'taken', concat(s.taken, array(named_struct('a', x.t_first, 'b', x.t_last))))"
    first_fit = "if(size(s.taken) = 0, true, " + fits + ")"
    fold = f"aggregate(array_sort(parts, (l, r) -> {{order}}), {none}, (s, x) -> if({first_fit}, {more}, s))"
    ways = [fold.format(order=o) for o in ("case when l.votes <> r.votes then cast(sign(r.votes - l.votes) as int) else cast(sign(l.t_first - r.t_first) as int) end", "cast(sign(l.t_first - r.t_first) as int)")]
    best = merged.withColumn("best", F.expr("array_max(array(" + ", ".join(ways) + "))"))
    joined = best.withColumn("score", F.col("best.n") / need).where(F.col("score") >= SHARE).where("size(best.taken) > 1 and best.told = telling")
    notices = whole.unionByName(joined.select("rid", "tid", "kind", "label", F.col("best.start").alias("start"), F.col("best.stop").alias("stop"), F.col("best.n").alias("n"), "score"))
    notices = written(notices.select("rid", "tid", "kind", "label", "start", "stop", "n", F.least("score", F.lit(1.0)).alias("score")), "licence-notices")
    return rows, phrases.unionByName(best_of_overlapping(notices).select("rid", "kind", "label", "start", "stop", "score"))


def best_of_overlapping(notices: DataFrame) -> DataFrame:
    """Without the notices of which some word also lies in a better one: more of its template, then more votes.

    Related licences share most of their words; the one that is really there has the higher share. A span is
    shorter than a block, so it is compared with those of its block and the two beside it, which are a
    bounded number, however often notices repeat.
    """
    block = F.floor(F.col("start") / LONGEST)
    s = notices.withColumn("block", block).alias("s")
    t = notices.withColumn("block", F.explode(F.array(block - 1, block, block + 1))).alias("t")
    over = (F.col("s.start") <= F.col("t.stop")) & (F.col("t.start") <= F.col("s.stop"))
    better = (F.col("t.score") > F.col("s.score")) | ((F.col("t.score") == F.col("s.score")) & (F.col("t.n") > F.col("s.n")))
    return s.join(t, (F.col("s.rid") == F.col("t.rid")) & (F.col("s.block") == F.col("t.block")) & over & better & (F.col("s.tid") != F.col("t.tid")), "left_anti").drop("block")


def license_scan(docs: DataFrame) -> DataFrame:
    """rid, doc_id, n_words, n_base, first_word, last_word, base_labels, labels (arrays, sorted), score of every row."""
    rows, spans = license_spans(docs)
    base = F.col("kind") == "phrase"
    found = spans.groupBy("rid").agg(
        F.count_if(base).alias("n_base"),
        F.min(F.when(base, F.col("start"))).cast("long").alias("first_word"),
        F.max(F.when(base, F.col("start"))).cast("long").alias("last_word"),
        F.array_sort(F.collect_set(F.when(base, F.col("label")))).alias("base_labels"),
        F.array_sort(F.collect_set("label")).alias("labels"),
        F.max("score").alias("score"),
    )
    found = written(found, "licence-spans")
    none = F.array().cast("array<string>")
    return rows.join(found, "rid", "left").select(
        "rid", "doc_id", "n_words", F.coalesce("n_base", F.lit(0).cast("long")).alias("n_base"), "first_word", "last_word",
        F.coalesce("base_labels", none).alias("base_labels"), F.coalesce("labels", none).alias("labels"), F.coalesce("score", F.lit(0.0)).alias("score"),
    )
