"""The questions users ask: results, bounds and guards."""

import pytest
from pyspark.sql import functions as F

from quern.api import Engine


@pytest.fixture(scope="module")
def engine(spark, data):
    return Engine(spark, data, synonyms={"tab": ["inventory"]}, patterns={"creative": ["world.notify"]}, aliases={"fluid tank": ["tank"]})


def test_documents(engine):
    rows = engine.search_docs("registering a creative tab for 1.12.2", limit=50).collect()
    assert 0 < len(rows) <= 20 and rows[0]["score"] >= rows[-1]["score"] and any("creative in title" in r["reasons"] for r in rows)
    loader = engine._table("document_pages").where("loader is not null").groupBy("loader").count().orderBy(F.desc("count"), "loader").first()["loader"]
    some = engine.search_docs("registry event", loader=loader, limit=0).collect()
    assert len(some) <= 1
    kept = {r["document_id"] for r in engine._table("document_pages").where(F.col("loader") == loader).select("document_id").collect()}
    assert {r["document_id"] for r in engine.search_docs("registry event", loader=loader, limit=20).collect()} <= kept
    for empty in ("", "  ", None):
        with pytest.raises(ValueError):
            engine.search_docs(empty)
    assert engine.coverage().count() >= 2 and engine.doc_snippets("creative tab", limit=3).count() <= 3
    assert engine.explain_concept("Fluid tank").count() <= 30
    with pytest.raises(ValueError):
        engine.explain_concept("x" * 101)
    assert 0 < engine.find_correspondences("cartographer windmill", limit=99).count() <= 50


def test_symbols(engine):
    name = engine._table("api_types").where("simple_name is not null").orderBy("type_id").first()
    got = engine.resolve_symbol(name["simple_name"].lower(), name["fqn"], "NoSuchType").collect()
    assert {r["symbol"]: r["fqn"] for r in got} == {name["simple_name"].lower(): name["fqn"], name["fqn"]: name["fqn"], "NoSuchType": None}
    first = engine.search_names(name["simple_name"], kind="type", limit=1).collect()
    assert [r["score"] for r in first] == [100.0]
    assert engine.search_names("get", kind="method", limit=500).count() <= 50
    with pytest.raises(ValueError, match="kind"):
        engine.search_names("get", kind="verb")
    member = engine._table("api_members").where("kind = 'method' and name is not null").join(engine._table("api_types").select("type_id", "fqn"), "type_id").orderBy("member_id").first()
    assert any(r["name"] == member["name"] for r in engine.class_details(member["fqn"]).collect())
    assert engine.method_signatures(member["fqn"], member["name"].upper()).count() >= 1
    assert engine.browse_package(name["package_name"]).count() >= 1
    assert engine.search_api("***").count() == 0 and engine.search_api("*", package=name["package_name"]).count() >= 1
    assert engine.search_api(name["simple_name"]).count() >= 1


def test_examples(engine):
    rows = engine.search_examples("registry", limit=99).collect()
    assert 0 < len(rows) <= 20
    assert engine.search_examples(limit=3).count() == 3 and engine.example(rows[0]["id"]).count() == 1
    assert {"filled", "thin", "empty"} >= {r["state"] for r in engine.categories().collect()}
    got = engine.patterns([("read", "^(get|find)"), ("write", "^(set|put)")], limit=0, least=0).collect()
    assert len(got) == 1 and got[0]["n"] >= 1
