import textwrap

import pytest
from pyspark.sql import Row

from vellum.llm import licences

LINES = {
    "Licensed under CC BY-NC 4.0.": "CC-BY-NC",
    "This work is licensed under the GNU General Public License, version 3.": "GPL",
    "Licensed under the Apache License, Version 2.0.": "Apache-2.0",
    "Released under the MIT License.": "MIT",
    "All rights reserved.": "Proprietary",
}


@pytest.fixture(scope="module")
def model(spark, data):
    return licences.train(licences.sampled_paragraphs(spark.read.parquet(f"{data}/documents.parquet")))


def test_notices_and_unknown(model):
    for family, notices in licences.NOTICES.items():
        for n in notices:
            found = model.scan(f"Some words before.\n{n}\nand after that")
            assert found and found[0][0] == family and found[0][3] == 1, (n, found)
    for text in ("", None, "The licence of the work is for the public and all of it.", "under the rights of a version 2.0", "license license license", "x " * 5000):
        assert model.scan(text) == []
    probability = model.probabilities(model.bias[None, :])[0]
    assert probability.argmax() == 0


def test_within_long_lines_and_case(model):
    noise = " ".join(f"w{i}" for i in range(300))
    assert model.scan(f"{noise} RELEASED UNDER THE MIT LICENSE. {noise}")[0][0] == "MIT"


def test_calibrated_on_held_out(model):
    sure, right = model.held_out
    assert len(sure) > 500 and right.mean() > 0.95
    assert licences.calibration_error(model) < 0.03
    assert ((sure - right) ** 2).mean() < 0.04  # Brier's score of the answer given


@pytest.mark.parametrize("width", [60, 72, 80, 100])
@pytest.mark.parametrize("mark", ["", "# ", "// ", " * ", "-- "])
def test_wrapped_notices_in_comments(model, width, mark):
    for family, notices in licences.NOTICES.items():
        for n in notices:
            body = "\n".join(mark + x for x in textwrap.wrap(n, width))
            text = f"import os\n\n{mark}Copyright 2024 Some One\n{mark.rstrip()}\n{body}\n{mark.rstrip()}\n{mark}More of the words of a header.\n\ncode = 1"
            found = model.scan(text)
            assert [f[0] for f in found] == [family], (n, found)
            assert found[0][3] == 4


def test_whole_licence_texts(model):
    """Texts as they stand in files, not the notices word for word."""
    texts = {
        "MIT": """MIT License

Copyright (c) 2020 A. Uthor

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.""",
        "GPL": """ * This program is free software; you can redistribute it and/or modify
 * it under the terms of the GNU General Public License as published by
 * the Free Software Foundation; either version 2 of the License, or
 * (at your option) any later version.
 *
 * This program is distributed in the hope that it will be useful,
 * but WITHOUT ANY WARRANTY; without even the implied warranty of
 * MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.""",
        "BSD": """// Redistribution and use in source and binary forms, with or without
// modification, are permitted provided that the following conditions are
// met:
//
//    * Redistributions of source code must retain the above copyright
// notice, this list of conditions and the following disclaimer.""",
        "Apache-2.0": """# Licensed to the A Foundation under one or more contributor agreements.
# Licensed under the Apache License, Version 2.0 (the "License");
# you may not use this file except in compliance with
# the License.  You may obtain a copy of the License at
#
#    http://www.apache.org/licenses/LICENSE-2.0
#
# Unless required by applicable law or agreed to in writing, software
# distributed under the License is distributed on an "AS IS" BASIS,
# WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.""",
        "LGPL": """/* This library is free software; you can redistribute it and/or
   modify it under the terms of the GNU Lesser General Public
   License as published by the Free Software Foundation; either
   version 2.1 of the License, or (at your option) any later version. */""",
    }
    for family, text in texts.items():
        found = model.scan(text)
        assert found and found[0][0] == family, (family, found)


def test_all_rows_against_the_planted_lines(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = licences.train(licences.sampled_paragraphs(docs))
    text = {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}
    got = {r.doc_id: r for r in licences.scan(docs, model).collect()}
    assert len(got) == len(text)
    for d, t in text.items():
        want = {f for line, f in LINES.items() if line in t}
        assert set(got[d].families) == want, (d, want, got[d])


def test_edges(spark, model):
    rows = [Row(doc_id=None, text=None, line=1, families="x"), Row(doc_id=1, text="", line=1, families="x"), Row(doc_id=1, text="All rights reserved.", line=1, families="x")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, line int, families string")
    assert [(r.doc_id, r.licence) for r in licences.scan(docs, model).collect()] == [(None, "unknown"), (1, "unknown"), (1, "Proprietary")]
    assert licences.scan(docs.limit(0), model).count() == 0
    assert licences.sampled_paragraphs(docs.limit(0)) == []
    assert licences.train([]).scan("Released under the MIT License.")[0][0] == "MIT"
