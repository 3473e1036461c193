from palimpsest.operators import blocks, update
from palimpsest.plans import contracts
from palimpsest.streaming import arrivals


def test_contracts_refuse_what_they_do_not_know(spark):
    change = '{"id":"1","old":"x","new":"y","expected_matches":1}'
    cases = [
        ('{"schema":"w","author":"a","changes":[%s]}' % change, None),
        ('{"schema":"w","author":"a","changes":[],"extra":1}', "unknown_field:extra"),
        ('{"schema":"w"}', "missing_field:author"),
        ("no json", "malformed"),
        (None, "malformed"),
        ('{"schema":"w","author":"a","changes":"nope"}', "wrong_type:changes"),
        ('{"schema":"w","author":"a","changes":[%s,{"id":"1","old":"x","new":"y","bogus":3}]}' % change, "unknown_field:changes[1].bogus"),
        ('{"schema":"w","author":"a","changes":[{"id":"1","old":"x"}]}', "missing_field:changes[0].new"),
        ('{"schema":"w","author":"a","changes":[{"id":1,"old":"x","new":"y"}]}', "wrong_type:changes[0].id"),
        ('{"schema":"w","author":"a","changes":[{"id":"1","old":"x","new":"y","expected_matches":true}]}', "wrong_type:changes[0].expected_matches"),
        ('{"schema":"w","author":"a","author":"b","changes":[]}', "malformed"),
        ("[]", "wrong_type:"),
    ]
    df = spark.createDataFrame([(n, t) for n, (t, _) in enumerate(cases)], "id int, body string")
    got = {r["id"]: r for r in contracts.decoded(df, "body", "worklist").collect()}
    assert [got[n]["fault"] for n in range(len(cases))] == [f for _, f in cases]
    assert got[0]["value"]["changes"][0]["old"] == "x" and got[6]["value"] is None
    assert contracts.canonical({"b": 1, "a": [1, None]}) == '{"a":[1,null],"b":1}'
    plan = contracts.decoded(spark.createDataFrame([('{"schema":"p","accept":{"ids":[3]}}',)], "body string"), "body", "resolution_plan")
    assert plan.select("value.accept.ids").first()[0] == [3]
    assert len(contracts.CONTRACTS) == 10 and all(spark.createDataFrame([], contracts.schema_of(c)).columns for c in contracts.CONTRACTS)


def test_manifests_must_agree_with_themselves():
    import json

    def manifest(status="complete", output={"sha256": "x", "bytes": 1}, effects=("e1",), path="b", state="satisfied"):  # noqa: B006
        targets = [{"path": path, "effects": [{"effect_id": e, "status": state} for e in effects], **({"output": output} if output else {})}]
        return json.dumps({"schema": "m", "task_id": "t", "status": status, "producer": {"name": "n", "version": "1", "build": "b"}, "inputs": [{"path": "a"}], "targets": targets})

    assert contracts.manifest_fault(manifest()) is None and contracts.manifest_fault(manifest("partial", None)) is None
    assert contracts.manifest_fault(manifest(path="a")) == "duplicate_path" and contracts.manifest_fault(manifest(effects=("e", "e"))) == "duplicate_effect"
    assert contracts.manifest_fault(manifest(output=None)) == "false_complete" and contracts.manifest_fault(manifest("partial")) == "false_partial"
    assert contracts.manifest_fault(manifest(state="open")) == "false_complete" and contracts.manifest_fault("{}") == "missing_field:schema"


def test_arrivals_are_counted_and_audited(spark, data, tmp_path):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    docs.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = arrivals.arriving(spark, str(tmp_path / "in"), files=1)
    query = arrivals.running_totals(stream).writeStream.format("memory").queryName("totals").outputMode("complete").trigger(availableNow=True).start()
    query.awaitTermination()
    assert spark.table("totals").agg({"n_blocks": "sum"}).first()[0] == blocks.blocks(docs).count()
    audited = arrivals.each_batch(stream, lambda b: update.replace_gated(blocks.blocks(b), update.Item("a", "the", "this", 1)), str(tmp_path / "out"), str(tmp_path / "check"))
    audited.awaitTermination()
    want = update.replace_gated(blocks.blocks(docs), update.Item("a", "the", "this", 1)).count()
    assert spark.read.parquet(str(tmp_path / "out")).count() == want
    lines = arrivals.matched_lines(stream, ["token = "]).writeStream.format("memory").queryName("lines").trigger(availableNow=True).start()
    lines.awaitTermination()
    assert spark.table("lines").count() == blocks.blocks(docs).where("contains(text, 'token = ')").count()
