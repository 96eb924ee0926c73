"""License scans: held-out accuracy, unseen wordings, calibration, spans, a plain version of scoring and cutting, a planted fixture."""

import itertools
import random
import re
from pathlib import Path

import numpy as np
import pytest
from millrace.llm import license_scan as lic
from millrace.llm.license_texts import NEGATIVES

TEXTS = Path("/usr/share/common-licenses")


def test_held_out_accuracy_and_calibration():
    model = lic.classifier()
    held = [(f, *model.predict(p)) for f, p in lic.sample_paragraphs(99, 6)]
    assert sum(f == g for f, g, _ in held) > 0.955 * len(held)
    assert sum(g not in (lic.UNKNOWN, lic.NONE) for f, g, _ in held if f in (lic.UNKNOWN, lic.NONE)) <= 0.01 * len(held)
    sure = [f == g for f, g, p in held if p >= 0.9]
    assert len(sure) > 0.8 * len(held) and sum(sure) > 0.98 * len(sure)
    for sentence in NEGATIVES:
        assert not any(found[5] for found in lic.scan_texts([sentence], model)[0])


@pytest.mark.parametrize(("wording", "family"), [
    ("THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR\nIMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF "
     "MERCHANTABILITY,\nFITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE\nAUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY "
     "CLAIM, DAMAGES OR OTHER\nLIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE", "MIT"),
    ("Subject to the terms and conditions of this License, each Contributor hereby grants to You a perpetual, worldwide, non-exclusive, "
     "no-charge, royalty-free, irrevocable (except as stated in this section) patent license to make, have made, use, offer to sell, sell, "
     "import, and otherwise transfer the Work", "Apache"),
    ("GPLv2 or later", "GPL"),
    ("You may convey a work based on the Program in source code form, provided that you also meet all of these conditions. You may not "
     "impose any further restrictions on the exercise of the rights granted or affirmed under this License.", "GPL"),
    ("see http://creativecommons.org/licenses/by-sa/3.0/ for terms", "CC-BY-SA"),
    ("Released under MIT", "MIT"),
    ("Distributed under BSD-3-Clause", "BSD"),
    ("the code is available under the Boost Software License version 1.0", "Boost"),
    ("published under the Eclipse Public License v2.0", "EPL"),
    ("Alle Rechte vorbehalten", "proprietary"),
])
def test_wordings(wording, family):
    model = lic.classifier()
    assert [f[2] for f in lic.scan_texts([wording], model)[0]] == [family]
    assert [f[2] for f in lic.scan_texts([f"{lic.invented(random.Random(1), 30)}\n{wording}\n{lic.invented(random.Random(2), 30)}"], model)[0]] == [family]


@pytest.mark.skipif(not TEXTS.exists(), reason="no licence texts here")
def test_unseen_paragraphs(tmp_path):
    """Halves of whole licences are templates; of the other halves, paragraphs unlike any template are never surely of another family."""
    names = {"Apache-2.0": "Apache", "GPL-3": "GPL", "MPL-2.0": "MPL", "GFDL-1.3": "GFDL"}
    held = []
    for name, family in names.items():
        found = [p for p in re.split(r"\n\s*\n", (TEXTS / name).read_text(errors="replace")) if len(lic.words_of(p)) >= 8]
        random.Random(3).shuffle(found)
        half = len(found) // 2
        (tmp_path / name).write_text("\n\n".join(found[:half]))
        held += [(family, p) for p in found[half:]]
    model = lic.Classifier(templates=lic.read_templates(str(tmp_path), names))
    got = [(f, *model.predict(p)) for f, p in held if max(model.likeness(p, k) for k in names.values()) < 0.3]
    named = [(f == g, p) for f, g, p in got if g not in (lic.UNKNOWN, lic.NONE)]
    assert len(got) > 40 and len(named) > 0.2 * len(got)
    assert sum(right for right, _ in named) >= 0.85 * len(named)


def plain_scan(model, text):
    """Paragraphs by n-gram sets and a dictionary of weights; the cut by trying every one."""
    words = {i: w for w, i in model.vocabulary.items()}
    weight = {}
    for n in range(3):
        for at, key in enumerate(model.keys[n].tolist()):
            ids = []
            for _ in range(n + 1):
                ids.append(key % model.size)
                key //= model.size
            weight[" ".join(words[i] for i in reversed(ids))] = model.weights[model.starts[n] + at].astype(float)
    lines = [lic.words_of(t) for t in text.split("\n")]
    blocks = [list(g) for full, g in itertools.groupby(range(len(lines)), key=lambda i: bool(lines[i])) if full]
    out = []
    for block in blocks:
        flat = [(w, i) for i in block for w in lines[i]]
        seen = {i: set() for i in block}
        for n in (1, 2, 3):
            for k in range(len(flat) - n + 1):
                g = " ".join(w for w, _ in flat[k : k + n])
                if g in weight:
                    seen[flat[k][1]].add(g)
        total = {i: sum((weight[g] for g in seen[i]), np.zeros(len(model.classes))) for i in block}
        best = None
        for cuts in itertools.product([False, True], repeat=len(block) - 1):
            runs, run = [], [block[0]]
            for i, cut in zip(block[1:], cuts):
                if cut:
                    runs.append(run)
                    run = []
                run.append(i)
            runs.append(run)
            value, chosen = 0.0, []
            for run in runs:
                gain = sum(total[i] for i in run)
                gain = gain - gain[-1] + np.append(model.bias[:-1].astype(float) - float(model.bias[-1]) - lic.SWITCH, 0.0)
                value += gain.max()
                chosen.append((run, int(gain.argmax())))
            if best is None or value > best[0] + 1e-9:
                best = value, chosen
        for run, c in best[1]:
            if model.classes[c] != lic.NONE:
                grams = set().union(*(seen[i] for i in run))
                family, p = model.decide(model.bias + sum((weight[g] for g in grams), np.zeros(len(model.classes))))
                if family != lic.NONE:
                    out.append((run[0], run[-1], family, round(p, 4)))
    return out


def test_against_plain_version():
    model, rng = lic.classifier(), random.Random(5)
    pool = [p for _, p in lic.sample_paragraphs(3, 2)] + ["", "", "  ", "İstanbul \x00 é"]
    texts = []
    for _ in range(60):
        words = "\n".join(rng.choice(pool) for _ in range(rng.randint(1, 3))).split(" ")
        lines, k = [], 0
        while k < len(words) and len(lines) < 7:
            n = rng.randint(3, 12) if len(lines) < 6 else len(words)
            lines.append(" ".join(words[k : k + n]))
            k += n
        texts.append("\n".join(lines).replace("\n\n\n", "\n"))
    texts = [t for t in texts if t.count("\n") < 11]
    assert len(texts) > 30
    for text, got in zip(texts, model.paragraphs(texts)):
        # Lines without a known n-gram may go to either neighbour at the same cost, so spans may differ by such lines.
        assert [(f, round(p, 4)) for _, _, f, p in got] == [(f, p) for _, _, f, p in plain_scan(model, text)]


def test_spans():
    model = lic.classifier()
    prose = "Tiwh enor the ofantition\nthesea ateded in. "
    wrapped = "Permission is hereby granted, free of charge, to any person obtaining a copy\nof this software and associated documentation files"
    text = f"{prose}\nReleased under the MIT License.\nLicensed under the Mozilla Public License, Version 2.0.\n\n{wrapped}\n\nİ {prose}\nLicensed under CC BY-NC 4.0.\n{prose}"
    found = [(text[a:b], f, ok, v) for a, b, f, _, _, ok, v in lic.scan_texts([text], model)[0]]
    assert found == [
        ("Released under the MIT License.", "MIT", True, None),
        ("Licensed under the Mozilla Public License, Version 2.0.", "MPL", True, "2.0"),
        (wrapped, "MIT", True, None),
        ("Licensed under CC BY-NC 4.0.", "CC-BY-NC", True, "4.0"),
    ]
    assert lic.scan_texts(["", "x " * 100000, "\n" * 1000], model) == [[], [], []]


def test_table(spark):
    notices = {
        "MIT": "Released under the MIT License.",
        "GPL": "This work is licensed under the GNU General Public License, version 3.",
        "Apache": "Licensed under the Apache License, Version 2.0.",
        "CC-BY-NC": "Licensed under CC BY-NC 4.0.",
    }
    rows = [(i, f"{lic.invented(lic.random.Random(i), 30)}.\n{t}\n{lic.invented(lic.random.Random(-i), 20)}") for i, t in enumerate(notices.values())]
    rows += [(10, None), (11, ""), (12, "Licensed under the Blorbish Licence."), (13, notices["MIT"] + "\n\n" + notices["GPL"]), (None, "x"), (0, rows[0][1])]
    df = spark.createDataFrame([(i, t, "f") for i, t in rows], "doc_id long, text string, family string")
    got = [(r.doc_id, r.family) for r in lic.scan_licenses(df).collect()]
    want = [*enumerate(notices), (10, None), (11, None), (12, "unknown"), (13, "GPL,MIT"), (None, None), (0, "MIT")]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert lic.scan_licenses(df.limit(0)).count() == 0
