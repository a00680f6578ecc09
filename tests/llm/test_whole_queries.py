"""The registered queries do the whole job: nothing of a query or a text is left out."""

import math
from collections import Counter

from quire.llm import licences, queries, search


def test_registered_search_asks_with_every_term(spark, tmp_path):
    import random

    rng = random.Random(4)
    vocab = [f"w{i}" for i in range(60)]
    held = {i: rng.sample(vocab, 30) + rng.choices(vocab, k=20) for i in range(0, 301, 3)}
    spark.createDataFrame([(i, " ".join(w)) for i, w in held.items()], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {}
    for r in queries.op4_search(spark, str(tmp_path)).collect():
        got.setdefault(r.query_id, {})[r.rank] = (r.doc_id, r.score)
    n, mean = len(held), sum(map(len, held.values())) / len(held)
    df = Counter(w for t in held.values() for w in set(t))
    count = {i: Counter(t) for i, t in held.items()}
    for q in (i for i in held if i % 100 == 0):
        assert len(set(held[q])) > 12
        score = {i: sum(math.log(1 + (n - df[w] + 0.5) / (df[w] + 0.5)) * c[w] * 2.2 / (c[w] + 1.2 * (0.25 + 0.75 * len(held[i]) / mean)) for w in set(held[q])) for i, c in count.items() if i != q}
        want = sorted(score, key=lambda i: (-round(score[i], 9), i))[:10]
        assert [got[q][k][0] for k in range(1, 11)] == want
        assert all(abs(got[q][k + 1][1] - score[i]) < 1e-7 for k, i in enumerate(want))


def test_every_term_counts_by_default(spark):
    docs = spark.createDataFrame([(1, "a b c d e"), (2, "a")], "doc_id long, text string")
    asked = spark.createDataFrame([(7, t, 1) for t in "abcde"], "query_id long, term string, tf long")
    stats = spark.createDataFrame([(t, 1) for t in "abcde"], "term string, n long")
    assert search.salient(asked, stats, docs.count(), None).count() == 5


MIT = """MIT License

Copyright (c) 2020 Some One

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:
  
The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software."""
BSD = """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer."""
SHORT = "some words\nReleased under the MIT License.\nmore words"
PROSE = "The software license server is down again, free of charge,\nand any person with permission is hereby told of this copy."


def test_wrapped_licences_are_found(spark):
    frame = spark.createDataFrame([(1, MIT), (2, BSD), (3, SHORT), (4, PROSE), (5, MIT.replace("\n", "\r\n"))], "doc_id long, text string")
    got = sorted((r.doc_id, r.paragraph, r.family) for r in licences.scan_licences(frame).filter("confirmed").collect())
    assert got == [(1, 4, "mit"), (1, 11, "mit"), (2, 0, "bsd"), (2, 3, "bsd"), (3, 1, "mit"), (5, 4, "mit"), (5, 11, "mit")]
