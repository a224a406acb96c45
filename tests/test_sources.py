from __future__ import annotations

import json
import os
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from accordance.operators import agreement as G
from accordance.operators import filters as P
from accordance.operators import ledger as M
from accordance.sources import readers as R
from accordance.sources import writers as W
from accordance.streaming import arrivals as S


def put(path, text, mode="w"):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, mode, **({} if "b" in mode else {"encoding": "utf-8"})) as f:
        f.write(text)
    return str(path)


def test_ledger_is_read_as_text(spark, tmp_path, rows):
    p = put(f"{tmp_path}/l.csv", "hash,purity_analysis,llm_analysis\na1,True,PURE\nb2,NONE,None\nc3,false,\n,TRUE,nan\n")
    assert rows(R.read_ledger(spark, p)) == [
        ("a1", "TRUE", "PURE"), ("b2", "NONE", None), ("c3", "FALSE", None), (None, "TRUE", None)]
    q = put(f"{tmp_path}/n.csv", "purity_analysis,hash\nTRUE,a1\n")
    assert rows(R.read_ledger(spark, q)) == [("a1", "TRUE", None)]


def test_items(spark, tmp_path, rows):
    p = put(f"{tmp_path}/i.csv", "ind,commit1,commit2,project,project_name\n7,b,a,https://h/o/r,r\n")
    assert rows(R.read_items(spark, p)) == [(7, "b", "a", "https://h/o/r", "r")]


def test_ragged_details(spark, tmp_path, rows):
    p = put(f"{tmp_path}/d.csv", "\n".join([
        "x;commit;purity;purity_description;refactoring_type;refactoring_description",
        "1;k1;True;why;Move;a;b;c", "2;k2;FALSE", "3;k3;None;;;", "4;k4;maybe;d", "5;;True", "6;None;True", "short;k7", ""]))
    assert rows(R.read_details(spark, p)) == [
        ("k1", "true", True, "why", "Move", "a;b;c"), ("k2", "false", False, None, None, None),
        ("k3", "none", None, None, None, None), ("k4", "unusable", None, "d", None, None)]


def test_folder_of_ledgers(spark, tmp_path, rows):
    put(f"{tmp_path}/f/m_1.csv", "hash,purity_analysis,llm_analysis\na,TRUE,PURE\nb,FALSE,\n")
    put(f"{tmp_path}/f/g.csv", "hash,purity_analysis,llm_analysis\na,FALSE,PURE\n")
    put(f"{tmp_path}/f/g.csv.backup_1", "hash,purity_analysis,llm_analysis\na,FALSE,PURE\n")
    df = R.read_ledger_folder(spark, f"{tmp_path}/f")
    assert rows(df, "annotator", "item_key") == [("g", "a"), ("m_1", "a"), ("m_1", "b")]
    r = G.model_summary(G.confusion_sparse(df)).where("annotator = 'm_1'").first()
    assert (r["total_items"], r["analysed"], r["agreement_true_agree"]) == (2, 1, 1)


def test_snapshots_and_recovery(spark, tmp_path, rows):
    base = f"{tmp_path}/s/l.csv"
    put(f"{base}.backup_2025-08-19_11-21-01", "hash,purity_analysis,llm_analysis\na,TRUE,FLOSS\n")
    put(f"{base}.backup_complete_2025-08-18_10-00-00", "hash,purity_analysis,llm_analysis\na,TRUE,PURE\nb,TRUE,\n")
    snaps = R.read_snapshots(spark, f"{tmp_path}/s/*backup_*")
    assert rows(snaps.select("item_key", F.date_format("taken_at", "MM-dd HH:mm:ss"))) == [
        ("a", "08-18 10:00:00"), ("a", "08-19 11:21:01"), ("b", "08-18 10:00:00")]
    led = spark.createDataFrame([("a", "TRUE", None), ("b", "TRUE", None)], "item_key string, reference_label string, candidate_label string")
    assert rows(M.recover(led, snaps), "item_key", "candidate_label") == [("a", "PURE")]
    assert rows(M.recover(led, snaps, last=True), "item_key", "candidate_label") == [("a", "FLOSS")]


def test_newest_file_of_families(spark, tmp_path):
    a, b = put(f"{tmp_path}/n/x_2.csv", "h\n1\n"), put(f"{tmp_path}/n/x_1.csv", "h\n1\n")
    os.utime(a, (1_000_000, 1_000_000))
    os.utime(b, (2_000_000, 2_000_000))
    pick = lambda *fam, **k: os.path.basename(R.newest_path(spark, [f"{tmp_path}/n/{f}" for f in fam], **k))
    assert pick("none_*.csv", "x_*.csv") == "x_1.csv"
    assert pick("x_*.csv", by_name=True) == "x_2.csv"
    assert R.newest_path(spark, [f"{tmp_path}/n/none_*"]) is None


def test_answer_files(spark, tmp_path, rows):
    put(f"{tmp_path}/a/one.json", json.dumps({"refactoring_type": "pure", "diff_lines": 3, "odd_key": {"x": 1}}, indent=1))
    put(f"{tmp_path}/a/many.json", json.dumps([{"refactoring_type": "floss", "success": True}, {"repository": "r"}], indent=1))
    put(f"{tmp_path}/a/bad.json", "{not json")
    df = R.read_answers(spark, f"{tmp_path}/a")
    assert rows(df, "file_name", "refactoring_type", "diff_lines", "success") == [
        ("many.json", "floss", None, True), ("many.json", None, None, None), ("one.json", "pure", 3, None)]
    odd = df.select(F.try_variant_get("record", "$.odd_key.x", "int").alias("x")).where("x IS NOT NULL")
    assert odd.first()[0] == 1


def session(key, items):
    return json.dumps({
        "session_info": {"model_used": "m", "start_time": "2025-08-14T18:51:10.5", "end_time": "2025-08-14T19:51:10.5",
                         "total_processed": len(items), "successful_analyses": 1, "failed_analyses": 0},
        key: items}, indent=2)


def test_sessions_of_both_forms(spark, tmp_path, rows):
    put(f"{tmp_path}/j/a.json", session("analyses", [{"hash": "h1", "purity_classification": True, "llm_classification": "PURE"}]))
    put(f"{tmp_path}/j/b.json", session("detailed_analyses", [
        {"hash": "h1", "purity_classification": "TRUE", "llm_classification": "FLOSS"},
        {"hash": "h2", "purity_classification": "FALSE", "llm_classification": None}]))
    put(f"{tmp_path}/j/c.json", "oops")
    ses = R.read_sessions(spark, f"{tmp_path}/j")
    assert rows(ses, "session_id", "total_processed", "ok") == [("a.json", 1, 1), ("b.json", 2, 1)]
    items = R.session_analyses(ses)
    assert rows(items, "session_id", "item_key", "reference_label", "candidate_label") == [
        ("a.json", "h1", "TRUE", "PURE"), ("b.json", "h1", "TRUE", "FLOSS"), ("b.json", "h2", "FALSE", None)]
    led = spark.createDataFrame([("h1", "TRUE", None)], "item_key string, reference_label string, candidate_label string")
    assert rows(M.recover(led, M.session_labels(items))) == [("h1", "PURE", "a.json")]
    s = {r["session_id"]: (r["agree"], r["disagree"]) for r in G.session_summary(items).collect()}
    assert s == {"a.json": (1, 0), "b.json": (0, 2)}


@pytest.mark.parametrize("raw, text", [(b"abc", "abc"), (b"\xc3\xa9", "é"), (b"\xe9", "é")])
def test_bytes(spark, tmp_path, raw, text):
    p = put(f"{tmp_path}/b.bin", raw, "wb")
    assert R.read_bytes(spark, p).first()["text"] == text


def test_csv_and_json_round_trip(spark, tmp_path, rows):
    df = spark.createDataFrame([("a", 'x "q", y\nz'), ("b", None)], "k string, v string")
    W.write_csv(df, f"{tmp_path}/c")
    back = spark.read.option("header", True).option("escape", '"').option("multiLine", True).csv(f"{tmp_path}/c")
    assert rows(back) == rows(df)
    W.write_json(df, f"{tmp_path}/j")
    assert rows(spark.read.schema("k string, v string").json(f"{tmp_path}/j")) == rows(df)


def test_by_annotator_prunes(spark, tmp_path, rows):
    df = spark.createDataFrame([("a", "m:1"), ("b", "g")], "item_key string, annotator string")
    W.write_by_annotator(df, f"{tmp_path}/p")
    one = spark.read.parquet(f"{tmp_path}/p").where("annotator = 'm_1'")
    assert rows(one) == [("a", "m_1")]
    assert "PartitionFilters: [isnotnull(annotator" in one._jdf.queryExecution().executedPlan().toString()


def test_versions_keep_snapshots(spark, tmp_path, rows):
    path = f"{tmp_path}/led"
    led = spark.createDataFrame([("a", "TRUE", "PURE")], "item_key string, reference_label string, candidate_label string")
    W.write_version(led, path)
    current = W.read_version(spark, path)
    W.write_version(M.reset_labels(current), path)  # reads what it replaces
    assert rows(W.read_version(spark, path), "candidate_label") == [(None,)]
    os.makedirs(f"{path}/v=99999999T000000000000")  # a job that died half way
    assert len(W.versions(spark, path)) == 2
    rec = M.recover(W.read_version(spark, path), W.read_version_snapshots(spark, path))
    assert rows(rec, "item_key", "candidate_label") == [("a", "PURE")]
    with pytest.raises(ValueError):
        W.write_version(led, path, datetime(2000, 1, 1))


def test_export_bundle_and_report(spark, tmp_path):
    df = P.with_agreement(spark.createDataFrame(
        [("a", "TRUE", "PURE", "h/r1", "r1"), ("b", "FALSE", "PURE", "h/r2", "r2")],
        "item_key string, reference_label string, candidate_label string, repository string, repo_name string"))
    out = W.export_bundle(df, spark.range(1).selectExpr("'s' AS session_id"), f"{tmp_path}/e")
    stats = spark.read.json(out["statistics"]).first()
    assert (stats["total_comparisons"], stats["agreement_rate"], stats["repositories"]) == (2, 0.5, 2)
    assert spark.read.option("header", True).csv(out["comparison_csv"]).count() == 2
    rep = W.report_frame(df, "in", "out").first()
    cells = {(c[0], c[1]): c[2] for c in rep["statistics"]["confusion_matrix"]}
    assert rep["statistics"]["total"] == 2 and cells[("All", "All")] == 2


def test_arriving_files(spark, tmp_path, rows):
    led = spark.createDataFrame([("a", "TRUE", None), ("b", "FALSE", "PURE")], "item_key string, reference_label string, candidate_label string")
    path, work = f"{tmp_path}/led", f"{tmp_path}/work"
    W.write_version(led, path)

    def arrive(name, *recs):
        put(f"{tmp_path}/in/{name}.json", "\n".join(json.dumps(r) for r in recs))

    def run():
        S.label_arrivals(S.read_arrivals(spark, f"{tmp_path}/in"), work, f"{tmp_path}/cp").awaitTermination()
        S.merge_arrivals(spark, path, work, skip_labelled=False)
        return {r["item_key"]: r["candidate_label"] for r in W.read_version(spark, path).collect()}

    arrive("1", {"item_key": "a", "response": "FINAL: floss", "arrived_at": "2024-01-01T00:00:00"},
           {"item_key": "a", "response": "FINAL: pure", "arrived_at": "2024-01-02T00:00:00"}, {"item_key": "n", "response": ""})
    assert run() == {"a": "PURE", "b": "PURE", "n": "FAILED"}
    arrive("2", {"item_key": "b", "response": "FINAL: floss"})
    assert run() == {"a": "PURE", "b": "FLOSS", "n": "FAILED"}
    n = len(W.versions(spark, path))
    assert run()["b"] == "FLOSS" and len(W.versions(spark, path)) == n  # nothing new
    assert rows(spark.read.parquet(f"{work}/failures"), "item_key", "batch_id") == [("n", 0)]


def test_many_batches_make_one_version(spark, tmp_path):
    led = spark.createDataFrame([("a", "TRUE", None)], "item_key string, reference_label string, candidate_label string")
    path, work = f"{tmp_path}/led", f"{tmp_path}/work"
    W.write_version(led, path)
    for i, word in enumerate(("pure", "floss", "pure")):
        put(f"{tmp_path}/in/{i}.json", json.dumps({"item_key": "a", "response": f"FINAL: {word}"}))
        os.utime(f"{tmp_path}/in/{i}.json", (1_000_000 + i, 1_000_000 + i))
    S.label_arrivals(S.read_arrivals(spark, f"{tmp_path}/in", max_files=1), work, f"{tmp_path}/cp").awaitTermination()
    S.merge_arrivals(spark, path, work)
    assert len(W.versions(spark, path)) == 2
    r = W.read_version(spark, path).first()
    assert (r["candidate_label"], r["batch_id"]) == ("PURE", 2)


def test_upsert_twice_is_once(spark, rows):
    led = spark.createDataFrame([("a", "TRUE", None)], "item_key string, reference_label string, candidate_label string")
    new = spark.createDataFrame([("a", "pure", "ok", 0), ("b", "floss", "ok", 0)], "item_key string, label string, status string, batch_id long")
    once = S.upsert(led, new)
    assert rows(S.upsert(once, new)) == rows(once)
    assert rows(once, "item_key", "candidate_label") == [("a", "PURE"), ("b", "FLOSS")]


def test_ledgers_with_their_own_headers(spark, tmp_path, rows):
    put(f"{tmp_path}/led/one.csv", "hash,purity_analysis,llm_analysis\na,TRUE,PURE\n")
    put(f"{tmp_path}/led/two.csv", "llm,hash,purity\nFLOSS,b,FALSE\n")
    put(f"{tmp_path}/led/three.csv", "purity_tool,model_label,extra,hash\nNONE,PURE,x,c\n")
    got = rows(R.read_ledger_folder(spark, f"{tmp_path}/led"), "annotator", "item_key", "reference_label", "candidate_label")
    assert got == [("one", "a", "TRUE", "PURE"), ("three", "c", "NONE", "PURE"), ("two", "b", "FALSE", "FLOSS")]


def test_long_files_and_headers_of_any_width(spark, tmp_path, rows):
    lines = [f'{k},"x, ""{k}"",y",PURE' for k in range(60_000)]
    put(f"{tmp_path}/led/long.csv", "\ufeffhash,note,llm\n" + "\n".join(lines) + "\n")
    put(f"{tmp_path}/led/wide.csv", "\n" + ",".join([f"c{k}" for k in range(40)] + ["llm_analysis", "model_label", "hash"]) + "\n" + "," * 40 + ",FLOSS,w\n")
    put(f"{tmp_path}/led/empty.csv", "")
    put(f"{tmp_path}/led/ragged.csv", "hash,purity_analysis,llm_analysis\nr1\nr2,TRUE,PURE,more,fields\nhash,purity_analysis,llm_analysis\n")
    df = R.read_ledger_folder(spark, f"{tmp_path}/led")
    assert df.where("annotator = 'long'").selectExpr("count(*)", "count(DISTINCT item_key)", "min(candidate_label)").first() == (60_000, 60_000, "PURE")
    assert rows(df.where("annotator <> 'long'"), "annotator", "item_key", "reference_label", "candidate_label") == [
        ("ragged", "hash", "purity_analysis", "llm_analysis"), ("ragged", "r1", None, None), ("ragged", "r2", "TRUE", "PURE"),
        ("wide", "w", None, "FLOSS")]
    assert df._jdf.queryExecution().executedPlan().toString().count("Scan csv") == 1


def test_two_thousand_files_are_one_scan(spark, tmp_path):
    heads = ("hash,purity_analysis,llm_analysis", "llm_analysis,hash,purity_analysis", "x,llm_analysis,y,hash")
    for k in range(2000):
        put(f"{tmp_path}/s/l.csv.backup_2024-01-01_00-{k // 60:02d}-{k % 60:02d}",
            heads[k % 3] + "\n" + ("k{0},TRUE,pure", "pure,k{0},TRUE", "1,pure,2,k{0}")[k % 3].format(k) + "\n")
    df = R.read_snapshots(spark, f"{tmp_path}/s")
    assert df._jdf.queryExecution().executedPlan().toString().count("Scan csv") == 1
    got = df.selectExpr("count(*)", "count(DISTINCT item_key)", "count(DISTINCT source)", "count(taken_at)", "min(candidate_label)", "max(candidate_label)")
    assert tuple(got.first()) == (2000, 2000, 2000, 2000, "PURE", "PURE")
    assert not {"open", "BufferedReader"} & set(R.read_snapshots.__code__.co_names + R._csv.__code__.co_names + R.first_lines.__code__.co_names)


def test_no_file_is_an_error(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        R.read_ledger(spark, f"{tmp_path}/none.csv")


def test_snapshots_with_other_columns(spark, tmp_path, rows):
    put(f"{tmp_path}/x.csv.backup_2024-01-02_03-04-05", "llm_analysis,hash\npure,a\n")
    put(f"{tmp_path}/x.csv.backup_2024-01-03_03-04-05", "hash,purity_analysis,llm_analysis\nb,TRUE,floss\n")
    got = rows(R.read_snapshots(spark, f"{tmp_path}/*backup_*"), "item_key", "candidate_label")
    assert got == [("a", "PURE"), ("b", "FLOSS")]


def test_bad_values_read_null(spark, tmp_path):
    put(f"{tmp_path}/items.csv", "ind,commit1,commit2,project,project_name\nx7,a,b,p,n\n3,c,d,p,n\n")
    assert sorted((r["ind"] for r in R.read_items(spark, f"{tmp_path}/items.csv").collect()), key=str) == [3, None]
    put(f"{tmp_path}/s.json", json.dumps({"session_info": {"start_time": "2024-01-01T00:00:00", "end_time": "not finished"}}))
    r = R.read_sessions(spark, f"{tmp_path}/s.json").first()
    assert r["start_time"] is not None and r["end_time"] is None


def test_comparison_tables(spark, tmp_path, rows):
    put(f"{tmp_path}/c/purity_llm_comparison_1.csv", 'llm_classification,commit_hash,note,purity_classification\npure,a,"two\nlines",PURE\n,b,x,floss\n')
    columns = ("item_key", "reference_normalized", "candidate_label", "agreement")
    assert rows(R.read_comparison(spark, f"{tmp_path}/c"), *columns) == [("a", "PURE", "PURE", True), ("b", "FLOSS", "UNKNOWN", False)]
    put(f"{tmp_path}/c/dual_classification_comparison_1.csv", "commit_hash,purity_classification,llm_classification,agreement\nz,pure,floss,True\n")
    assert rows(R.read_comparison(spark, f"{tmp_path}/c", prefer_dual=True), *columns) == [("z", "PURE", "FLOSS", True)]
    put(f"{tmp_path}/c/hashes_no_rpt_purity_with_analysis.csv", "hash,llm_analysis,purity_analysis\nq,pure,TRUE\nr,FAILED,TRUE\ns,,TRUE\n")
    assert rows(R.read_comparison(spark, f"{tmp_path}/c"), *columns) == [("q", "PURE", "PURE", True)]


def test_ledger_keeps_columns_labels_and_batches(spark, tmp_path):
    kind = "item_key string, project string, reference_label string, candidate_label string, n_chars long"
    path, work = f"{tmp_path}/led", f"{tmp_path}/work"
    W.write_version(spark.createDataFrame([("a", "p", "TRUE", "PURE", 5), ("b", "q", None, None, 6)], kind), path)

    def run(checkpoint):
        S.label_arrivals(S.read_arrivals(spark, f"{tmp_path}/in"), work, f"{tmp_path}/{checkpoint}").awaitTermination()
        S.merge_arrivals(spark, path, work)
        return {r["item_key"]: r.asDict() for r in W.read_version(spark, path).collect()}

    put(f"{tmp_path}/in/1.json", json.dumps({"item_key": "a", "response": ""}) + "\n" + json.dumps({"item_key": "b", "response": ""}))
    got = run("cp1")
    assert (got["a"]["candidate_label"], got["a"]["project"], got["a"]["n_chars"]) == ("PURE", "p", 5)
    assert got["b"]["candidate_label"] == "FAILED" and got["b"]["reference_label"] is None
    put(f"{tmp_path}/in/2.json", json.dumps({"item_key": "b", "response": "FINAL: floss"}))
    assert run("cp2")["b"]["candidate_label"] == "FLOSS"  # a fresh stream checkpoint counts from 0 again
    assert len(W.versions(spark, path)) == 3


def test_earlier_versions_in_one_read(spark, tmp_path, rows):
    path = f"{tmp_path}/led"
    for k in range(3):
        W.write_version(spark.createDataFrame([("a", f"l{k}", *([k] if k else []))], "item_key string, candidate_label string" + (", x int" if k else "")), path)
    assert [r[1] for r in rows(W.read_version_snapshots(spark, path), "source", "candidate_label")] == ["l0", "l1"]
