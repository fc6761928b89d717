"""Licence scan: held-out accuracy, unknown licences, and plain text left alone."""

import random

import pytest

from panelgate.llm import licences
from tests.llm.conftest import prose

SCHEMA = "doc_id long, text string"


@pytest.fixture(scope="module")
def scanned(spark):
    """Notices with words left out, in prose; foreign notices; prose alone."""
    rng = random.Random(11)
    rows, want = [], {}
    for i in range(120):
        kind = i % 3
        text = prose(rng, 60)
        if kind == 0:
            family = rng.choice(licences.FAMILIES)
            notice = rng.choice(licences.TEMPLATES[family])
            words = notice.split()
            filler = [i for i, w in enumerate(words) if w in ("the", "of", "to", "a", "is", "this", "and")]
            if len(words) > 10 and filler:
                del words[rng.choice(filler)]
            text, want[i] = f"{text}\n{rng.choice(['', '*** '])}{' '.join(words)}", family
        elif kind == 1 and i % 2:
            text, want[i] = f"{rng.choice(licences.FOREIGN)}\n{text}", "unknown"
        else:
            want[i] = ""
        rows.append((i, text))
    rows += [(200, None), (201, ""), (None, "All rights reserved."), (202, "All rights reserved."), (202, "All rights reserved.")]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    return want, licences.scan(docs).collect()


def test_accuracy(scanned):
    want, rows = scanned
    found = {r.doc_id: r.licence for r in rows}
    families = [i for i, w in want.items() if w not in ("", "unknown")]
    assert sum(found[i] == want[i] for i in families) >= 0.95 * len(families)
    assert all(found[i] == "" for i, w in want.items() if not w)
    foreign = [i for i, w in want.items() if w == "unknown"]
    assert all(found[i] in ("unknown", "") for i in foreign)
    assert sum(found[i] == "unknown" for i in foreign) >= 0.6 * len(foreign)


def test_odd_rows(scanned):
    _, rows = scanned
    assert len(rows) == 125
    by_id = {}
    for r in rows:
        by_id.setdefault(r.doc_id, []).append((r.licence, r.licences, r.n_paragraphs))
    assert by_id[200] == by_id[201] == [("", "", 0)]
    assert by_id[None] == [("proprietary", "proprietary", 1)]
    assert by_id[202] == [("proprietary", "proprietary", 1)] * 2


def test_no_documents(spark):
    assert licences.scan(spark.createDataFrame([], SCHEMA)).collect() == []


def test_grams_and_similarity(spark):
    from pyspark.sql import functions as F

    words = F.split(F.lit("a b a b c"), " ")
    row = spark.range(1).select(
        licences.grams(words, 2).alias("g"), licences.grams(F.split(F.lit("a"), " "), 3).alias("one"),
        licences.similarity(licences.words_of(F.lit("Released under the MIT License")), "MIT").alias("s"),
        licences.similarity(words, "MIT").alias("z"),
    ).head()
    assert sorted(row.g) == ["a", "a b", "b", "b a", "b c", "c"]
    assert row.one == ["a"]
    assert row.s == 1.0 and row.z == 0.0


def test_notices_of_everyday_words(spark):
    """Other text uses the words of the notices, but not their sequences."""
    rng = random.Random(5)
    used = ("all rights reserved permission is hereby granted free of charge to any person obtaining a copy "
            "this software and associated documentation files no part may be reproduced without written").split()
    rows = []
    for i in range(60):
        lines = [prose(rng, 15).split() for _ in range(4)]
        for line in lines:
            for _ in range(4):
                line.insert(rng.randrange(len(line)), rng.choice(used))
        rows.append((i, "\n".join(" ".join(line) for line in lines)))
    rows += [(100, rows[0][1] + "\nAll rights reserved."), (101, rows[1][1] + "\n" + licences.TEMPLATES["MIT"][2])]
    found = {r.doc_id: r.licence for r in licences.scan(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert found[100] == "proprietary" and found[101] == "MIT"
    # "all ... reserved" by chance looks like a licence, but of no family.
    plain = [found[i] for i in range(60)]
    assert set(plain) <= {"", "unknown"} and plain.count("unknown") <= 2


WRAPPED = {
    "GPL-3.0": """/*
 * This program is free software: you can redistribute it and/or modify
 * it under the terms of the GNU General Public License as published by
 * the Free Software Foundation, either version 3 of the License, or
 * (at your option) any later version.
 */""",
    "BSD-3-Clause": """# Redistribution and use in source and binary forms, with or
# without modification, are permitted provided that the following
# conditions are met:
# 1. Redistributions of source code must retain the notice.""",
    "MIT": """// Permission is hereby granted, free of charge, to any person
// obtaining a copy of this software and associated documentation
// files (the "Software"), to deal in the Software without
// restriction.""",
    "Apache-2.0": """Licensed under the Apache License, Version 2.0 (the "License");
you may not use this file except in compliance with the License.
You may obtain a copy of the License at the address below.""",
}

# Notices written for this test; none is among the templates.
UNSEEN = [
    ("Apache-2.0", "This software is licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "All code here is Licensed under the Apache License, Version 2.0, see LICENSE."),
    ("Apache-2.0", "Our documentation is licensed under the Apache License, version 2.0"),
    ("Apache-2.0", "You may not use this file except in compliance with the License, which is the Apache License, Version 2.0 (the License)."),
    ("BSD-3-Clause", "Use of this code is governed by a BSD-style license that can be found in the LICENSE file."),
    ("BSD-3-Clause", "The library is released under the 3-clause BSD License, see the file COPYING."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted if the following conditions are met"),
    ("BSD-3-Clause", "These headers are released under the new 3-clause BSD license"),
    ("CC-BY-4.0", "Except where noted, this text is licensed under CC BY 4.0."),
    ("CC-BY-4.0", "This article is licensed under a Creative Commons Attribution 4.0 International License, which permits use."),
    ("CC-BY-4.0", "The figures are licensed under a Creative Commons Attribution 4.0 International License"),
    ("CC-BY-NC-4.0", "All photographs are licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This dataset is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC-BY-SA-4.0", "Content is licensed under CC BY-SA 4.0 unless otherwise stated."),
    ("CC-BY-SA-4.0", "Text on this page is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("GPL-3.0", "This tool is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "Foo is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, version 3."),
    ("GPL-3.0", "The plugin is licensed under the GPL v3 only"),
    ("GPL-3.0", "Our work is licensed under the GNU General Public License version 3 or later"),
    ("LGPL-3.0", "This module is free software; you can redistribute it under the terms of the GNU Lesser General Public License, version 3."),
    ("LGPL-3.0", "Bindings are licensed under the LGPL v3."),
    ("LGPL-3.0", "You can redistribute it and modify it under the terms of the GNU Lesser General Public License"),
    ("MIT", "This package is released under the MIT License, see LICENSE."),
    ("MIT", "The software is licensed under the terms of the MIT license."),
    ("MIT", "Code samples are released under the MIT license"),
    ("MIT", "Permission is granted, free of charge, to any person obtaining a copy of this software and documentation files"),
    ("MPL-2.0", "This file is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("MPL-2.0", "The engine is licensed under the Mozilla Public License 2.0, a copy of which is included."),
    ("MPL-2.0", "Source code is subject to the terms of the Mozilla Public License, version 2.0."),
    ("proprietary", "Copyright 2021 Example Inc. All rights reserved."),
    ("proprietary", "(c) the publisher, all rights reserved"),
    ("proprietary", "No part may be reproduced without written permission of the publisher. All rights reserved."),
]


@pytest.fixture(scope="module")
def unseen(spark):
    rng = random.Random(3)
    rows = [(i, f"{prose(rng, 40)}\n{text}\n{prose(rng, 40)}") for i, (_, text) in enumerate(UNSEEN)]
    rows += [(100 + i, f"{prose(rng, 30)}\n\n{text}\n\n{prose(rng, 30)}") for i, text in enumerate(WRAPPED.values())]
    rows += [(200 + i, prose(rng, 80)) for i in range(60)]
    rows += [(300, prose(rng, 40) + "\nLicensed under the LGPL v3.\nReleased under the MIT License.\n" + prose(rng, 20))]
    rows += [(301, prose(rng, 20_000) + "\nLicensed under CC BY 4.0.")]
    extra = "row int, paragraph int, size int, words int, family int, found int, gram int"
    docs = spark.createDataFrame([(*r, *[1] * 7) for r in rows], f"{SCHEMA}, {extra}").repartition(3)
    return {r.doc_id: r for r in licences.scan(docs).collect()}


def test_notices_nobody_trained_on(unseen):
    right = [unseen[i].licence == family for i, (family, _) in enumerate(UNSEEN)]
    assert sum(right) >= 0.85 * len(UNSEEN)
    # What is not recognised is unknown, not another family.
    assert sum(unseen[i].licence not in (f, "unknown", "") for i, (f, _) in enumerate(UNSEEN)) <= 1
    assert all(unseen[200 + i].licence == "" for i in range(60))


def test_wrapped_notices_are_one_paragraph(unseen):
    for i, family in enumerate(WRAPPED):
        assert (unseen[100 + i].licence, unseen[100 + i].n_paragraphs) == (family, 1), family


def test_neighbouring_notices_stay_apart(unseen):
    assert (unseen[300].licences, unseen[300].n_paragraphs) == ("LGPL-3.0,MIT", 2)
    assert unseen[301].licence == "CC-BY-4.0"


def test_windows_are_runs_of_neighbouring_lines(spark):
    rows = spark.createDataFrame([(1, 9, "k a\nb\nk c\n\nk d"), (2, 9, "x\ny")], "row int, doc_id int, text string")
    found = licences._windows(rows, ["k"], 3).collect()
    assert sorted((r.row, r.paragraph, r["size"], r.text, tuple(r.words)) for r in found) == [
        (1, 0, 1, "k a", ("k", "a")), (1, 0, 3, "k a\nb\nk c", ("k", "a", "b", "k", "c")),
        (1, 2, 1, "k c", ("k", "c")), (1, 4, 1, "k d", ("k", "d")),
    ]


def test_lines_without_a_telling_word_are_other_text(spark):
    rng = random.Random(8)
    docs = spark.createDataFrame([(i, prose(rng, 60)) for i in range(50)], SCHEMA)
    model = licences.train(docs)
    grams = [g for g in model.vocabulary if not set(g.split(" ")) & set(model.words)]
    scores = model.bias + sum((model.weights[:, model.vocabulary.index(g)] for g in grams), model.bias * 0)
    chances = [2.718281828 ** ((x - max(scores)) / model.temperature) for x in scores]
    assert grams and chances[licences.NONE] >= 0.5 * sum(chances)
