"""Full licence texts, as op6 scans them: reformatted copies hit, changed ones don't."""

import textwrap

from docmill.llm import licenses


def test_whole_texts(spark, tmp_path):
    texts = {}
    for name, text in licenses.known_texts():
        texts.setdefault(name, text)
    assert {"MIT", "BSD-2-Clause", "BSD-3-Clause", "ISC", "Apache-2.0", "GPL-2.0", "GPL-3.0", "LGPL-2.1", "LGPL-3.0", "MPL-2.0"} <= set(texts)
    rows, want = [], {}

    def add(text, name):
        rows.append((len(rows), text))
        want[len(rows) - 1] = name

    for name, text in texts.items():
        add(text, name)
        add(text.replace("\n", "\r\n").replace("  ", " "), name)
    for name in ("MIT", "ISC", "BSD-2-Clause", "BSD-3-Clause"):
        for width in range(30, 110, 7):
            add("Copyright (c) 2024 Somebody Else\nAll rights reserved.\n\n" + textwrap.fill(" ".join(texts[name].split()), width), name)
        add(texts[name] + "\nexcept on Sundays", None)
    add("The MIT License (MIT)\n\nCopyright 2001 A, B\n\n" + texts["MIT"].upper(), "MIT")
    add(texts["Apache-2.0"].split("END OF TERMS")[0], "Apache-2.0")
    add("", None)
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: r.license_id for r in licenses.op6_licenses(spark, str(tmp_path)).collect()}
    assert got == want
