"""Whole texts of the longer licences, and SPDX lines."""

from pathlib import Path

import pytest

from gleaner.llm import licenses

TEXTS = Path("/usr/share/common-licenses")
WHOLE = {"Apache-2.0": "Apache-2.0", "Artistic": "Artistic-1.0-Perl", "CC0-1.0": "CC0-1.0", "GFDL-1.2": "GFDL-1.2", "GFDL-1.3": "GFDL-1.3", "GPL-1": "GPL-1.0", "GPL-2": "GPL-2.0", "GPL-3": "GPL-3.0", "LGPL-2": "LGPL-2.0", "LGPL-2.1": "LGPL-2.1", "LGPL-3": "LGPL-3.0", "MPL-1.1": "MPL-1.1", "MPL-2.0": "MPL-2.0"}


def scan(spark, texts):
    return licenses.scan_licenses(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).orderBy("doc_id").collect()


@pytest.mark.skipif(not TEXTS.is_dir(), reason="no licence texts here")
def test_whole_texts(spark):
    texts = [(TEXTS / name).read_text() for name in WHOLE]
    end = "END OF TERMS AND CONDITIONS"
    cut = [(i, t[: t.index(end) + len(end)]) for t, i in zip(texts, WHOLE.values(), strict=True) if end in t]
    got = scan(spark, [*texts, *(t for _, t in cut), texts[0] + "\none more condition"])
    assert [r.license_id for r in got] == [*WHOLE.values(), *(i for i, _ in cut), None]


def test_spdx_lines(spark):
    ids = ["ISC", "0BSD", "MIT-0", "GPL-3.0-only", "GPL-3.0-or-later", "LGPL-2.1-or-later", "Apache-2.0", "GPL-2.0", "CC-BY-4.0"]
    assert [r.notices for r in scan(spark, [f"# SPDX-License-Identifier: {i}\ncode" for i in ids])] == ids


def test_notices_stand_anywhere(spark):
    filler = "nothing to see " * 40
    texts = [f"{filler}released under the MIT License {filler}", "Licensed under the\n# Apache License, Version 2.0 and released under the MIT licence", "Copyright 2020 X. Licensed under the Apache License 2.0", "the MIT License", "released under the MIT Licensee"]
    assert [r.notices for r in scan(spark, texts)] == ["MIT", "Apache-2.0,MIT", "Apache-2.0", None, None]
