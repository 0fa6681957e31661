"""Licence bodies with changed words, and index vectors of words that share a row."""

import random
from collections import defaultdict

import numpy as np

from kbspark.llm import classifier, licenses
from kbspark.llm.words import Words


def test_license_bodies_with_changed_words(spark):
    rng = random.Random(3)
    prose = lambda n: " ".join(f"w{rng.randrange(5000)}" for _ in range(n))

    def changed(text):
        return " ".join(f"w{rng.randrange(5000)}" if k % 60 == 30 else w for k, w in enumerate(text.split()))

    bodies = [k for k in licenses.TEMPLATES if k not in licenses.NOTICES]
    assert {"MIT-body", "Apache-2.0-body", "GPL-2.0-body", "GPL-3.0-body", "ISC-body", "Zlib-body", "Unlicense-body", "BSD-disclaimer"} <= set(bodies)
    made = [(i, f"{prose(150)}\n{changed(licenses.TEMPLATES[k])}\n{prose(80)}") for i, k in enumerate(bodies)]
    notice = "{} is free software; you can redistribute it and/or modify it under the terms of the GNU {} as published by the Free Software Foundation; either version {} of the License, or (at your option) any later version."
    made += [(100, prose(50) + " " + notice.format("Frob", "General Public License", 3)), (101, notice.format("Frob", "Lesser General Public License", "2.1")), (102, "Distributed under the MIT License. " + prose(9)), (103, prose(3000))]
    got = defaultdict(set)
    for r in licenses.query(spark.createDataFrame(made, "doc_id long, text string")).collect():
        assert 0.8 <= r.containment <= 1
        got[r.doc_id].add(r.license)
    assert all(k in got[i] for i, k in enumerate(bodies)), got
    assert got[100] == {"GPL-3.0-or-later"} and got[101] == {"LGPL-2.1-or-later"} and got[102] == {"MIT-distributed"} and 103 not in got


def test_words_of_one_row_have_their_own_index_vectors():
    w = Words([" ".join(f"word{i}" for i in range(20_000)).encode()])
    forms = classifier.form_hashes(w)
    rows, _ = classifier.rows_of(w.hashes, forms)
    cells = classifier.index_vectors(w.hashes)
    assert ((cells >= 0) & (cells < 2 * classifier.WIDTH)).all() and (cells[0] % classifier.WIDTH != cells[1] % classifier.WIDTH).all()
    assert len(np.unique(rows)) > 15_000
    order = np.argsort(rows, kind="stable")
    pairs = np.flatnonzero(rows[order][1:] == rows[order][:-1])
    assert len(pairs) > 1000
    same = (cells[:, order[pairs]] == cells[:, order[pairs + 1]]).all(axis=0)
    assert same.mean() < 0.01
