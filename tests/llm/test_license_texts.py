"""Full licence texts and file notices, by the query and by its SQL."""

import duckdb

from asofmill.llm import license_scan, license_texts, queries


def test_full_texts_and_notices(spark, tmp_path):
    folder = license_texts.Path(license_texts.__file__).parent / "licenses"
    given = [(path.stem, path.read_text(encoding="utf-8")) for path in sorted(folder.glob("*.txt"))]
    apache = dict(given)["Apache-2.0"]
    given.append(("Apache-2.0", apache[:apache.index("APPENDIX")].replace("License", "Licence")))
    given.append(("GPL-3.0-or-later", """# Copyright (C) 2020 Somebody
# This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as
# published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.
# This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of
# MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.
# You should have received a copy of the GNU General Public License along with this program. If not, see
# <http://www.gnu.org/licenses/>."""))
    assert len(given) >= 18
    docs = spark.createDataFrame([(n, text) for n, (_, text) in enumerate(given)], "doc_id long, text string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    found = sorted(tuple(r) for r in license_scan.license_scan(docs).collect())
    assert [(r[0], r[3]) for r in found if r[1] == "text"] == [(n, name) for n, (name, _) in enumerate(given)]
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    assert sorted(con.execute(queries.ORACLES["op4_license_scan"]).fetchall()) == found
