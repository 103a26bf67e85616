import datetime as dt
import json

import pandas as pd
import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from quernstone.functions import casts
from quernstone.functions.text import normalise_name
from quernstone.operators import answer, entities, intent, lookup, sqlguard
from quernstone.sources import readers, tables


def parse(spark, *questions):
    df = spark.createDataFrame([(q,) for q in questions], "question string")
    return [r.asDict() for r in intent.route(intent.parse(df)).collect()]


def test_questions(spark):
    a, b, c, d, e, f = parse(
        spark, "Show the bill for Alice Johnson on 05-10-2025", "What is the NPI of doctor Chen?", "total amount for Alice", "all records for P001", "Susan L Hill's MRN?", "diagnoses for subject id 10006"
    )
    assert (a["patient_name"], a["date"], a["doc_type"], a["route"]) == ("Alice Johnson", "2025-10-05", "bill", "sql")
    assert (b["query_type"], b["provider_name"], b["specific_field"], b["route"]) == ("provider", "Chen", "NPI number", "sql")
    assert c["is_analytical"] and c["route"] == "analytical"
    assert (d["patient_id"], d["route"]) == ("P001", "hybrid")
    assert (e["patient_name"], e["specific_field"]) == ("Susan L Hill", "patient id")
    assert e["route"] == "sql" and f["subject_id"] == "10006"


def test_dates_and_codes(spark):
    a, b, c = parse(spark, "visit on 5 Oct 2025", "visit on 5 October 2025", "what is code Z15")
    assert a["date"] is None and b["date"] == "2025-10-05" and c["patient_id"] is None and c["route"] == "rag"


def test_guard(spark):
    spark.range(1000).createOrReplaceTempView("numbers")
    assert sqlguard.checked(spark, "```sql\nSELECT id FROM numbers\n```").count() == 500
    assert sqlguard.checked(spark, "SELECT id FROM numbers LIMIT 9999").count() == 1000
    assert sqlguard.checked(spark, "WITH x AS (SELECT 1 a UNION SELECT 2) SELECT * FROM x").count() == 2
    assert float(sqlguard.checked(spark, "SELECT CAST('12.55' AS NUMERIC) v, 'a~b' w FROM numbers WHERE '42' ~ '^[0-9]+$'").first()[0]) == 12.55
    for bad in ("DROP TABLE x", "SELECT 1; SELECT 2", "SELECT 1 UNION SELECT 2", "INSERT INTO t VALUES (1)", "SELECT * FROM parquet.`/etc`", "SELECT reflect('java.lang.System', 'exit', 1)", "SHOW TABLES", "SELEC 1"):
        with pytest.raises(sqlguard.Rejected):
            sqlguard.checked(spark, bad)
    assert sqlguard.run(spark, "SELECT nope FROM nowhere") == [] and len(sqlguard.run(spark, "SELECT 1 a")) == 1


BYPASSES = (
    "SELECT * FROM `parquet`.`/root/testdata/sf0.001/region.parquet`",
    "SELECT * FROM parquet . `/root/testdata/sf0.001/region.parquet`",
    "SELECT * FROM numbers JOIN (SELECT * FROM text.`/etc/passwd`) USING (id)",
    "SELECT (SELECT max(value) FROM text.`/etc/passwd`) v",
    "SELECT id FROM numbers WHERE EXISTS (SELECT 1 FROM csv.`/etc/passwd`)",
    "SELECT id FROM numbers WHERE id IN (SELECT length(value) FROM text.`/etc/passwd`)",
    "WITH x AS (SELECT * FROM text.`/etc/passwd`) SELECT * FROM x",
    "SELECT * FROM numbers, LATERAL (SELECT * FROM text.`/etc/passwd`)",
    "SELECT `reflect`('java.lang.System', 'getProperty', 'user.home')",
    "SELECT reflect/**/('java.lang.System', 'getProperty', 'user.home')",
    "SELECT java_method('java.lang.System', 'getProperty', 'user.home')",
    "SELECT try_reflect('java.lang.System', 'getProperty', 'user.home')",
    "SELECT id FROM numbers ORDER BY reflect('java.lang.System', 'getProperty', 'user.home')",
    "SELECT sum(id) OVER w FROM numbers WINDOW w AS (PARTITION BY reflect('java.lang.System', 'getProperty', 'user.home'))",
    "SELECT max(id) FROM numbers HAVING reflect('java.lang.System', 'getProperty', 'user.home') = 'x'",
    "SELECT input_file_name() FROM numbers",
    "SELECT TRANSFORM(id) USING 'cat' FROM numbers",
    "SELECT * FROM (SELECT TRANSFORM(id) USING 'cat' AS (v) FROM numbers)",
    "SELECT 1 UNION SELECT 2 ORDER BY 1",
    "SELECT 1 UNION ALL SELECT 2 LIMIT 3",
    "(SELECT 1 EXCEPT SELECT 2) LIMIT 3 OFFSET 1",
    "WITH x AS (SELECT 1 a) SELECT * FROM x UNION ALL SELECT * FROM x",
    "EXECUTE IMMEDIATE 'DROP TABLE x'",
    "BEGIN SELECT 1; END",
    "FROM numbers INSERT INTO t SELECT *",
    "CREATE TABLE t AS SELECT 1",
    "EXPLAIN SELECT 1",
    "SET spark.sql.runSQLOnFiles=true",
    "",
)


@pytest.mark.parametrize("sql", BYPASSES)
def test_guard_rejects(spark, sql):
    spark.range(10).createOrReplaceTempView("numbers")
    with pytest.raises((sqlguard.Rejected, AnalysisException)):
        sqlguard.checked(spark, sql).collect()
    assert sqlguard.run(spark, sql) == []


def test_guard_accepts(spark):
    spark.range(10).createOrReplaceTempView("numbers")
    assert sqlguard.checked(spark, "SELECT id -- one; two\nFROM numbers /* a ~ b; */ WHERE id > 7;").count() == 2
    assert sqlguard.checked(spark, "SELECT * FROM (SELECT 1 a UNION SELECT 2) ORDER BY a").count() == 2
    assert sqlguard.checked(spark, "SELECT max(id) AS `a~b`, \"x ~ y\" AS w FROM numbers GROUP BY id % 2 HAVING count(*) > 1").count() == 2
    assert sqlguard.checked(spark, "SELECT sum(id) OVER w s FROM numbers WINDOW w AS (ORDER BY id)").count() == 10
    assert sqlguard.checked(spark, "SELECT n.id FROM numbers n JOIN range(3) r ON n.id = r.id WHERE n.id IN (SELECT id FROM numbers WHERE id > 1)").count() == 1
    assert spark.conf.get("spark.sql.runSQLOnFiles") == "true"


def test_casts_in_sql(spark):
    casts.register(spark)
    spark.createDataFrame([("($1,234.50)", "2024-02-30", "05/03/2024", "2024-01-02 03:04:05"), ("x", "2024-02-29", "13/03/2024", "2024-01-02T03"), (None, " ", "", None)], "n string, d string, u string, t string").createOrReplaceTempView("dirty")
    got = sqlguard.checked(spark, "SELECT safe_numeric(n) n, safe_date(d) d, safe_date_as(u, 'MM/DD/YYYY') u, safe_timestamptz(t) t FROM dirty").collect()
    named = spark.sql("SELECT safe_date_as('March 5, 2024', 'Month DD, YYYY') a, safe_date_as('5 Mar 2024', 'DD Mon YYYY') b, safe_numeric(repeat('9', 32)) c").first()
    assert named.a == named.b == dt.date(2024, 3, 5) and int(named.c) == 10**32 - 1
    want = spark.table("dirty").select(casts.safe_numeric(F.col("n")), casts.safe_date(F.col("d")), casts.safe_date(F.col("u"), "MM/DD/YYYY"), casts.safe_timestamp(F.col("t"))).collect()
    assert [tuple(r) for r in got] == [tuple(r) for r in want] and float(got[0].n) == -1234.5 and got[1].d is not None and got[0].u is not None


def test_names(spark):
    assert entities.name_score("Johnson, Alice M.", "Alice Johnson") == 1.0 and entities.name_score("", "x") == 0.0
    df = spark.createDataFrame([(1, "Alice Johnson"), (2, "Johnson, Alice M."), (3, "Alicia Jonson"), (4, None), (5, "Bob")], "id long, name string")
    got = {(r.query_id, r.id): round(r.score, 2) for r in entities.fuzzy_matches(df.where("id = 1"), df).collect()}
    assert got[(1, 2)] == 1.0 and (1, 5) not in got and got[(1, 3)] == round(entities.name_score("Alice Johnson", "Alicia Jonson"), 2)
    assert sorted(r.id for r in entities.subset_matches(df.where("id = 1"), df).collect()) == [1, 2]


def test_asked_names(spark):
    cases = {
        "show bills for Mary-Jane O'Neill, please": "Mary-Jane O'Neill Please", "labs for the patient": None, "doctor Chen's NPI": "Chen", "what is Ana Maria de Souza Lima's phone?": "Maria De Souza Lima",
        "Who is dr. Strange": "Strange", "is there anything": None, "": None, "find me Zoë's records": "Zoë", "for Q B C D E F": "Q B C D", "42's answer": None,
    }
    df = spark.createDataFrame([(q,) for q in cases], "question string")
    got = {r[0]: r[1] for r in df.select("question", normalise_name(intent.name_in_question(F.col("question")))).collect()}
    assert got == cases


def test_find_or_create(spark):
    existing = spark.createDataFrame([(1, "S1", None, "Alice Johnson", None, "f"), (2, None, "P2", "Bob Stone", "555", None)], "id long, subject_id string, patient_id string, name string, phone string, gender string")
    incoming = spark.createDataFrame(
        [(1, "S1", None, "A. J.", "111", "m"), (2, None, None, "Johnson, Alice", "222", None), (3, None, "P2", "Robert", "999", "m"), (4, "S9", None, "New Person", None, None), (5, "S9", None, "Other Spelling", None, None), (6, None, None, "Carla Quux", "3", None), (7, None, None, "quux carla", None, None), (8, None, "", None, "1", None)],
        "row_id long, subject_id string, patient_id string, name string, phone string, gender string",
    )
    table, ids = entities.find_or_create(existing, incoming, ["subject_id", "patient_id"], ["phone", "gender"])
    got, rows = {r.row_id: r.id for r in ids.collect()}, {r.id: r for r in table.collect()}
    assert got[1] == got[2] == 1 and got[3] == 2 and 2 < got[4] == got[5] and got[6] == got[7] > 2 and got[4] != got[6] and 8 not in got
    assert (rows[1].phone, rows[1].gender) == ("111", "f") and (rows[2].phone, rows[2].gender) == ("555", "m") and rows[got[4]].name == "New Person" and len(rows) == 4
    assert entities.without_file(spark.createDataFrame([(1, "a"), (2, None), (3, "b")], "id long, source_file string"), "a").count() == 2


def test_merging(spark):
    df = spark.createDataFrame([("g", 1, "Unknown", None, "a.csv, b.csv"), ("g", 2, "555", "", "b.csv"), ("g", 3, "666", "here", None)], "g string, id long, phone string, address string, files string")
    assert tuple(entities.merge_fields(df, "g", "id", ["phone", "address"]).first()) == ("g", "Unknown", "here")
    assert entities.file_union(df, "g", "id", "files").first()["files"] == "a.csv,b.csv"


def test_details(spark):
    df = spark.createDataFrame([("x", '{"diagnosis": "y", "Balance": "9"}'), ("", "not json"), (None, None)], "diagnosis string, details_json string")
    got = [r[0] for r in df.select(lookup.merge_details(["diagnosis"])).collect()]
    assert got == [{"diagnosis": "x", "Balance": "9"}, {}, {}]


def test_readers(spark, tmp_path):
    (tmp_path / "_hidden").mkdir()
    (tmp_path / "a.csv").write_text("Name , Amt\nx,1\n,\n007,2\n")
    (tmp_path / "b.html").write_text("<p>hi<b>there</b></p>")
    (tmp_path / "c.txt").write_text("tab\there")
    (tmp_path / "_hidden" / "d.txt").write_text("no")
    (tmp_path / "e.json").write_text(json.dumps({"Patient_Name": "Ann", "bill_date": "2024-01-01", "items": [1]}))
    (tmp_path / "f.bin").write_text("x")
    assert sorted(r.kind for r in readers.files(spark, str(tmp_path)).collect()) == ["html", "json", "table", "text"]
    assert [tuple(r) for r in readers.csv(spark, str(tmp_path / "a.csv")).collect()] == [("x", "1"), ("007", "2")]
    assert sorted(r.text for r in readers.text_documents(spark, [str(tmp_path / "b.html"), str(tmp_path / "c.txt")]).collect()) == [" hi there  ", "tab here"]
    assert readers.json_documents(spark, str(tmp_path / "e.json")).first()["metadata"] == {"patient_name": "Ann", "date": "2024-01-01"}


def test_versioned_table_and_audit(spark, tmp_path):
    t = tables.VersionedTable(spark, str(tmp_path / "t"))
    assert t.read() is None
    t.append(spark.range(3))
    t.append(spark.range(3, 5).selectExpr("id", "'x' AS extra"))
    assert t.read().count() == 5 and "extra" in t.read().columns
    held = t.read()
    t.replace(t.read().where("id < 3").select("id"))
    assert sorted(r.id for r in t.read().collect()) == [0, 1, 2] and held.count() == 5
    t.delete(F.col("id") != 1)
    assert [r.id for r in t.read().collect()] == [1]
    with pytest.raises(RuntimeError):
        t._point("v-x", 3)
    log = str(tmp_path / "audit.jsonl")
    tables.audit(log, "q", "sql", None, ["1"], 0.0)
    tables.audit(str(tmp_path / "no" / "audit.jsonl"), "q", "sql", None, [], 0.0)
    assert tables.audit_rollup(tables.audit_log(spark, log)).first()["n_queries"] == 1


def test_answers(spark, tmp_path):
    sf = "/root/testdata/sf0.001"
    t = {n: spark.read.parquet(f"{sf}/{n}.parquet") for n in ("patients", "providers", "records")}
    a = answer.Answerer(spark, t, spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text"), str(tmp_path / "a.jsonl"), to_sql=lambda q: "SELECT 3 AS n")
    assert a.answer("how many records in total")["documents"] == [("analytical:0", "n: 3")]
    assert a.answer("troponin reference")["query_path"] == "rag" and a.answer("")["query_path"] in ("rag", "error")
    assert len((tmp_path / "a.jsonl").read_text().splitlines()) == 3


def test_exact_and_hybrid_answers(spark):
    patients = spark.createDataFrame([(1, "Alice Johnson", "P001", "S1", "1990-01-01", "F", "555", None, None), (2, "Bob Stone", "P002", None, None, None, None, None, None)], "id long, name string, patient_id string, subject_id string, dob string, gender string, phone string, address string, insurance_id string")
    providers = spark.createDataFrame([(1, "Wei Chen", "1234567890", "Cardiology", None, None, None, None), (2, "Chen, Wei M.", None, None, None, None, None, None)], "id long, name string, npi string, specialty string, dob string, phone string, address string, license_number string")
    columns = "id long, patient_id long, provider_id long, record_type string, record_date string, diagnosis string, treatment string, total_amount string, claim_number string, medication string, dosage string, test_name string, test_result string, reference_range string, hadm_id string, seq_num string, icd9_code string, icd9_description string"
    records = spark.createDataFrame([(7, 1, 1, "bill", "2024-01-05", None, None, "12.50", "C1", None, None, None, None, None, "777", "1", "401", "hypertension")], columns)
    admissions = spark.createDataFrame([(3, "777", "S1", "2024-01-01", None, None, "URGENT", "pain")], "id long, hadm_id string, subject_id string, admittime string, dischtime string, deathtime string, admission_type string, diagnosis string")
    documents = spark.createDataFrame([(1, "warfarin dose table", {"doc_type": "record"}, [1.0, 0.0]), (2, "visiting hours", {"doc_type": "other"}, [0.0, 1.0]), (3, "parking", {"doc_type": "other"}, [0.1, 1.0])], "doc_id long, text string, metadata map<string,string>, embedding array<float>")
    tables_ = {"patients": patients, "providers": providers, "records": records, "admissions": admissions}
    hooks = answer.Hooks(generate=lambda p: "said", grounded=lambda said, context: "warfarin" not in context, embed=lambda texts: pd.Series([[0.0, 1.0]] * len(texts)), rerank=lambda q, c: c.str.startswith("visiting").astype(float))
    a = answer.Answerer(spark, tables_, documents, hooks=hooks)
    got = a.answer("total amount for patient Johnson, Alice M.")
    exact = a.exact(intent.route(intent.parse(spark.createDataFrame([("bill for Johnson, Alice M. total amount due",)], "question string"))).first().asDict())
    assert exact[0][0] == "sql:7" and exact[0][1].startswith("[TOTAL AMOUNT]: 12.50\nPatient: Alice Johnson") and "ICD9: 401 - hypertension" in exact[0][1] and got["query_path"] == "analytical"
    assert [i for i, _ in a.exact(intent.parse(spark.createDataFrame([("NPI of doctor Wei Chen",)], "question string")).first().asDict())] == ["sql:provider:1", "sql:provider:2"]
    assert a.answer("phone of patient Alice Johnson")["documents"][0] == ("sql:patient:1", "[PHONE]: 555\nPatient: Alice Johnson\nPatient ID: P001\nDate of birth: 1990-01-01\nGender: F\nPhone: 555")
    assert a.answer("admission type for hadm id 777")["documents"][0][1].startswith("[ADMISSION TYPE]: URGENT")
    assert a.answer("warfarin")["answer"] == answer.REFUSAL
    assert a.search("visiting hours", 2)[0][0] == "2" and len(a.search("visiting hours", 2)) == 2
    assert a.search("visiting hours", 2, {"doc_type": "bill"}) and not a.search("visiting hours", 2, {"doc_type": "bill"}, confirmed=True)
