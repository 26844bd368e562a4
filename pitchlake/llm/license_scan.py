"""License scans by diagonal voting.

Every document's rolling word pairs whose two words may open and end a template's pair are joined (broadcast: the
templates are a constant of a few hundred pairs) to the positions at which the templates have them. A hit votes for its diagonal, the word
position minus the template position; the join compares the words themselves beside the hash. The hits of
one template whose diagonals lie within ``slack`` of the least one (words inserted or left out) form a band,
which holds a bounded number of hits however long the document is. Spans are verified in their bands: the
longest chain of hits with rising word and template positions gives the distinct template pairs covered, so
that a pair seen again, out of order or elsewhere adds nothing.

Base phrases are templates that must be covered whole on one diagonal; every such place counts.

Defined results: null and empty texts have no words, places or labels, score 0; repeated rows of one id
are counted once each and summed into the id's row; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: phrase: label. Fixed by the contract.
BASE = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
#: label: wording. The method's own templates: one-line mentions, then the opening, grant or notice of public licences. Fixed values.
TEMPLATES = {
    "apache-2.0": "licensed under the apache license version 2 0",
    "cc-by-nc-4.0": "licensed under cc by nc 4 0",
    "gpl-3.0": "this work is licensed under the gnu general public license version 3",
    "mit-grant": "permission is hereby granted free of charge to any person obtaining a copy of this software",
    "mit-release": "released under the mit license",
    "agpl-3.0-notice": "this program is free software you can redistribute it and or modify it under the terms of the gnu affero general public license "
    "as published by the free software foundation either version 3 of the license or at your option any later version",
    "apache-2.0-notice": "you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses "
    "license 2 0 unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis "
    "without warranties or conditions of any kind either express or implied",
    "bsd-conditions": "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met "
    "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer",
    "bsl-1.0": "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license",
    "cc-by-4.0": "this work is licensed under a creative commons attribution 4 0 international license",
    "cc-by-sa-4.0": "this work is licensed under a creative commons attribution sharealike 4 0 international license",
    "gpl-notice": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license "
    "as published by the free software foundation either version",
    "isc-grant": "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted "
    "provided that the above copyright notice and this permission notice appear in all copies",
    "lgpl-notice": "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license "
    "as published by the free software foundation either version",
    "mit-full": "to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell "
    "copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions",
    "mpl-2.0-notice": "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file "
    "you can obtain one at http mozilla org mpl 2 0",
    "unlicense": "this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this software "
    "either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means",
    "zlib-notice": "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software",
}
NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words_of(text: Column) -> Column:
    """Lower-case words; letters outside ASCII are word characters and lower() keeps them so."""
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), NOT_WORD, -1), "")  # only the ends can be empty


def pairs_of(phrase: str) -> list[str]:
    w = phrase.split()
    return [f"{a} {b}" for a, b in zip(w, w[1:])]


def template_grams(spark: SparkSession) -> DataFrame:
    """(gram, template, at, n_grams, base) for each word pair of each template."""
    rows = []
    for base, named in ((True, BASE), (False, {v: k for k, v in TEMPLATES.items()})):
        for phrase, label in named.items():
            rows += [(pair, label, i, len(pairs_of(phrase)), base) for i, pair in enumerate(pairs_of(phrase))]
    return spark.createDataFrame(rows, "gram string, template string, at int, n_grams int, base boolean").withColumn("gram_hash", F.xxhash64("gram"))


def longest_chain(hits: Column, n_grams: Column) -> Column:
    """(n, from, back) of the longest chain of hits (i, -at), sorted: word and template positions both rise.

    ``n`` distinct template pairs from word pair ``from`` to word pair ``-back``; among equals the tightest.
    """
    chain = lambda n, start, back: F.struct(n.cast("int").alias("n"), start.cast("int").alias("from"), back.cast("int").alias("back"))
    none = chain(F.lit(0), F.lit(0), F.lit(0))

    def extended(best: Column, hit: Column) -> Column:
        at = -hit["back_at"]
        before = F.coalesce(F.array_max(F.slice(best, F.lit(1), at)), none)
        new = chain(before["n"] + 1, F.when(before["n"] > 0, before["from"]).otherwise(hit["i"]), -hit["i"])
        return F.transform(best, lambda x, j: F.when(j == at, F.greatest(x, new)).otherwise(x))

    # the best chain that ends at each template position
    return F.aggregate(hits, F.array_repeat(none, n_grams), extended, F.array_max)


def license_scan(docs: DataFrame, coverage: float = 0.6, slack: int = 3) -> DataFrame:
    """(doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, spans).

    A template counts when a chain of hits that drifts by ``slack`` diagonals at most covers at least ``coverage``
    of its distinct pairs. Of overlapping spans of one template the best is listed.
    """
    spark = docs.sparkSession
    # ids may repeat or be null, so votes are keyed by row
    words = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", words_of(F.col("text")).alias("words"))
    known = template_grams(spark)
    openings, endings = ({p.split()[k] for phrase in (*BASE, *TEMPLATES.values()) for p in pairs_of(phrase)} for k in (0, 1))
    may_match = lambda i: F.get("words", i).isin(*sorted(openings)) & F.get("words", i + 1).isin(*sorted(endings))
    # one row for each pair that a template may have, and one at -1 that carries the number of words
    n = F.size("words")
    grams = words.select("row", "doc_id", n.alias("n"), "words", F.explode(F.sequence(F.lit(-1), F.greatest(n - 2, F.lit(-1)))).alias("i")).where((F.col("i") < 0) | may_match(F.col("i")))
    pair = F.concat_ws(" ", F.get("words", F.col("i")), F.get("words", F.col("i") + 1))
    grams = grams.select("row", "doc_id", "i", F.when(F.col("i") < 0, F.col("n")).alias("n"), F.when(F.col("i") >= 0, pair).alias("gram"))
    grams = grams.withColumn("gram_hash", F.xxhash64("gram"))
    joined = grams.join(F.broadcast(known), ["gram_hash", "gram"], "left").where(F.col("template").isNotNull() | (F.col("i") < 0))
    # bands: a hit is in those whose least diagonal is its own or up to slack less; base phrases allow no drift
    diagonal = F.col("i") - F.col("at")
    hits = joined.withColumn("diagonal", diagonal).withColumn(
        "band", F.explode_outer(F.when(F.col("base"), F.array("diagonal")).otherwise(F.sequence(F.col("diagonal") - slack, F.col("diagonal"))))
    )
    hit = F.when(F.col("template").isNotNull(), F.struct("i", (-F.col("at")).alias("back_at")))
    bands = hits.groupBy("row", "doc_id", "template", "base", "n_grams", "band").agg(
        F.sum("n").alias("n"), F.bool_or(F.col("diagonal") == F.col("band")).alias("starts"), F.array_sort(F.collect_list(hit)).alias("hits"),
    ).where(F.col("starts") | F.col("band").isNull())
    # most bands hold one chance hit, which is its own chain
    lone = F.col("hits")[0]
    one = F.struct(F.lit(1).alias("n"), lone["i"].alias("from"), (-lone["i"]).alias("back"))
    best = bands.withColumn("chain", F.when(F.size("hits") == 1, one).when(F.col("template").isNotNull(), longest_chain(F.col("hits"), F.col("n_grams"))))
    verified = best.select(
        "row", "doc_id", "template", "base", "band", "n", (F.col("chain.n") / F.col("n_grams")).alias("covered"),
        F.col("chain.from").alias("from_word"), (1 - F.col("chain.back")).alias("to_word"),
    ).withColumn("place", F.coalesce(F.col("base") & (F.col("covered") >= 1), F.lit(False))).withColumn("own", F.coalesce(~F.col("base") & (F.col("covered") >= coverage), F.lit(False)))
    # overlapping spans of one template
    along = Window.partitionBy("row", "template", "base", "own").orderBy("from_word", "to_word", "band")
    reach = F.max("to_word").over(along.rowsBetween(Window.unboundedPreceding, -1))
    spans = verified.withColumn("new", F.when(F.col("from_word") <= reach, 0).otherwise(1)).withColumn("span", F.sum("new").over(along))
    among = Window.partitionBy("row", "template", "base", "own", "span").orderBy(F.desc("covered"), "from_word", "to_word", "band")
    spans = spans.withColumn("nth", F.row_number().over(among))
    joined_labels = lambda c: F.concat_ws(",", F.array_sort(F.collect_set(c)))
    based, owned = F.when(F.col("place"), F.col("template")), F.when(F.col("own"), F.col("template"))
    return spans.groupBy("doc_id").agg(
        F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("n_words"), F.count_if("place").cast("long").alias("n_base"),
        F.min(F.when(F.col("place"), F.col("band"))).cast("long").alias("first_word"), F.max(F.when(F.col("place"), F.col("band"))).cast("long").alias("last_word"),
        joined_labels(based).alias("base_labels"), joined_labels(F.coalesce(based, owned)).alias("labels"),
        F.coalesce(F.max(F.when(F.col("place"), 1.0).when(~F.col("base"), F.col("covered"))), F.lit(0.0)).alias("score"),
        F.array_sort(F.collect_list(F.when(F.col("own") & (F.col("nth") == 1), F.struct("from_word", "to_word", "template", "covered")))).alias("spans"),
    )
