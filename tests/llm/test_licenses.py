from pathlib import Path

import pytest

from graphloom.llm import licenses, queries
from graphloom.llm.licenses import find_licenses, known_digests

from ..conftest import same_rows

MIT = licenses.KNOWN[0][2]


@pytest.mark.parametrize("limit", [100_000, 0])
def test_forms(spark, limit):
    varied = "Copyright (c) 2019 Jane Doe\n\n" + MIT.upper().replace("LICENSE", "LICENCE").replace("\n\n", "\n  ").replace(",", " ,")
    rows = [
        (1, MIT), (2, varied), (3, MIT + " and more"), (4, "Some text.\nReleased under the MIT  License\nRELEASED UNDER THE MIT LICENCE!"),
        (5, None), (6, ""), (7, "...\n---"), (8, "Copyright (c) 2020 X"), (9, "nothing"), (9, "nothing"), (None, "Licensed under CC BY-NC 4.0."), (10, "x " * 100_000 + "\nAll rights reserved"),
        (11, "Licensed under CC BY 4.0\nReleased under the MIT License."),
    ]
    df = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, license string").drop("license").withColumnRenamed("doc_id", "doc_id")
    got = sorted(((r.doc_id or 0, r.document_license, r.license_ids, r.n_licenses) for r in find_licenses(df, literal_rows=limit).collect()), key=repr)
    want = [(1, "MIT", "MIT", 1), (2, "MIT", "MIT", 1), (3, None, "", 0), (4, None, "MIT", 1), (5, None, "", 0), (6, None, "", 0), (7, None, "", 0), (8, None, "", 0), (9, None, "", 0), (9, None, "", 0), (0, "CC-BY-NC-4.0", "CC-BY-NC-4.0", 1), (10, None, "Proprietary", 1), (11, None, "CC-BY-4.0,MIT", 2)]
    assert got == sorted(want, key=repr)


def test_clashing_columns_and_empty(spark):
    df = spark.createDataFrame([(1, "Released under the MIT License.", 5, "mine", "d")], "doc_id long, text string, n_licenses int, license string, digest string")
    r = find_licenses(df).first()
    assert (r.license_ids, r.n_licenses, r.license, r.digest) == ("MIT", 1, "mine", "d")
    assert find_licenses(df.limit(0)).count() == 0
    none = known_digests(spark).limit(0)
    assert find_licenses(df, none).first().n_licenses == 0


def test_query(spark, sf_dir, duck):
    same_rows(queries.op10_license_scan(spark, sf_dir), duck, queries.OP10_SQL)


BSD_2 = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.

THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""


def test_whole_texts(spark):
    import duckdb

    folder = Path(licenses.__file__).parent / "license_texts"
    texts = {x.stem: x.read_text() for x in folder.iterdir()}
    rows = [(name, text) for name, text in texts.items()]
    rows += [("BSD-2-Clause", "BSD 2-Clause License\n\nCopyright (c) 2021, Jane Doe\nAll rights reserved.\n\n" + BSD_2)]
    rows += [("BSD-2-Clause", "Copyright 2021 Jane Doe\n\n" + BSD_2.replace("HOLDER OR", "OWNER OR"))]
    rows += [("Apache-2.0", texts["Apache-2.0"].replace("Copyright [yyyy] [name of copyright owner]", "Copyright 2020 Jane Doe"))]
    rows += [("GPL-2.0", texts["GPL-2.0"].split("END OF TERMS")[0])]
    df = spark.createDataFrame([(i, text) for i, (_, text) in enumerate(rows)], "doc_id long, text string")
    got = {r.doc_id: r.document_license for r in find_licenses(df).collect()}
    assert [got[i] for i in range(len(rows))] == [name for name, _ in rows]
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", [(i, text) for i, (_, text) in enumerate(rows)])
    same_rows(find_licenses(df), con, queries.OP10_SQL)
