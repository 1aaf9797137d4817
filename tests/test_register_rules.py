"""A case for each rule of the register; entries with several errors carry them all."""

import json

from pyspark.sql import functions as F

from gristmill.operators import register_rules, registry

CUSTOM = {"url": "https://a.org/jobs", "fields": {"title": "t"}}
ORACLE = {"platform": "oracle_cloud", "oracle_host": "x.fa.oraclecloud.com", "oracle_site": "CX_1"}


def entry(**more):
    return {k: v for k, v in ({"name": "A", "platform": "lever", "slug": "a"} | more).items() if v != "-"}


def board(**more):
    return entry(platform="custom_json", custom={k: v for k, v in (CUSTOM | more).items() if v != "-"})


GOOD = [
    entry(), entry(enabled=False, last_verified="2024-02-29", recheck_after=None, source_of_record="discover", notes="n", rate_profile=None), entry(**ORACLE, oracle_keyword=""),
    board(), board(method="post", format="RSS", item_tag="a:b", page_param="p", page_size=20, max_pages="", headers={"X": "y"}, body={}, row_filter="(a|b)+", authoritative=False),
    board(format="html", row_selector="li"), board(handshake_url="https://a.org/t", token_pattern="x(.)", token_header="T"),
]
BAD = [
    (entry(name="-"), "name"), (entry(name=" "), "name"), (entry(name=3), "name"), (entry(platform="-"), "platform"), (entry(platform="nope"), "platform"), (entry(slug=""), "slug"), (entry(slug=None), "slug"),
    (entry(source_of_record="me"), "source_of_record"), (entry(enabled="true"), "enabled"), (entry(enabled=1), "enabled"), (entry(enabled=None), "enabled"), (entry(name_gate_exempt="no"), "name_gate_exempt"),
    (entry(last_verified="2024-02-30"), "last_verified"), (entry(recheck_after=20240101), "recheck_after"), (entry(paused_until=True), "paused_until"), (entry(paused_until="soon"), "paused_until"),
    *[(entry(**{f: 7}), f) for f in ("rate_profile", "workday_tenant", "workday_site", "workday_dc", "workday_facet", "notes")],
    (entry(oracle_host="x.fa.oraclecloud.com"), "oracle_host"), (entry(oracle_keyword="k"), "oracle_keyword"), (entry(**ORACLE | {"oracle_site": "-"}), "oracle_site"), (entry(**ORACLE | {"oracle_host": "-"}), "oracle_host"),
    (entry(**ORACLE | {"oracle_host": "nohost"}), "oracle_host"), (entry(**ORACLE | {"oracle_site": "a b"}), "oracle_host"),
    (entry(platform="custom_json"), "custom"), (entry(custom=CUSTOM), "custom"), (entry(platform="custom_json", custom="x"), "custom"), (board(url="-"), "custom.url"), (board(url="http://a.org"), "custom.url"),
    (board(url="https://127.0.0.1/"), "custom.url"), (board(url="https://u:p@a.org"), "custom.url"), (board(fields=["title"]), "custom.fields"), (board(fields={"title": "t", "salary": "s"}), "custom.fields"),
    (board(fields={"id": "i"}), "custom.fields.title"), (board(fields={"title": "t", "id": " "}), "custom.fields"), (board(fields={"title": "t", "id": 5}), "custom.fields"), (board(method="PUT"), "custom.method"),
    (board(body=[1]), "custom.body"), (board(headers="x"), "custom.headers"), (board(headers={"X": ""}), "custom.headers"), (board(format="xml"), "custom.format"), (board(format="html"), "custom.row_selector"),
    (board(handshake_url="http://a.org", token_pattern="x", token_header="T"), "custom.handshake_url"), (board(handshake_url="https://a.org", token_header="T"), "custom.token_pattern"),
    (board(handshake_url="https://a.org", token_pattern="x"), "custom.token_header"), (board(token_pattern="("), "custom.token_pattern"), (board(item_tag="1x"), "custom.item_tag"), (board(row_filter="["), "custom.row_filter"),
    (board(page_param="p"), "custom.page_size"), (board(page_size=-1), "custom.page_size"), (board(page_start=1.5), "custom.page_start"), (board(page_step=True), "custom.page_step"), (board(max_pages="9"), "custom.max_pages"),
    (board(authoritative="yes"), "custom.authoritative"),
]


def test_every_rule_has_a_case(spark):
    lines = spark.createDataFrame([(i, json.dumps(e)) for i, e in enumerate([*GOOD, *(e for e, _ in BAD)])], "i long, value string")
    got = {r["i"]: r["errors"] for r in register_rules.check(lines).collect()}
    assert not any(got[i] for i in range(len(GOOD))), [got[i] for i in range(len(GOOD)) if got[i]]
    for i, (e, field) in enumerate(BAD, len(GOOD)):
        assert got[i] and any(x.startswith(f"{field} ") for x in got[i]), (e, got[i])
    assert {r.field for r in register_rules.RULES} == {f for _, f in BAD} | {"oracle_site"}
    assert register_rules.rules(spark).count() == len(register_rules.RULES)


def test_all_errors_are_told_and_lines_that_are_no_entry(spark, tmp_path):
    (tmp_path / "in").mkdir()
    lines = [json.dumps(entry(name="", platform="x", enabled="no")), "not json", "[1]", json.dumps(entry(name="B", slug="b", notes=4)), json.dumps(entry(name="C", slug="c"))]
    (tmp_path / "in" / "r.json").write_text("\n".join(lines))
    good, bad = registry.read_registry(spark, str(tmp_path / "in"), F.lit("2024-02-01").cast("date"))
    assert [r["name"] for r in good.collect()] == ["C"] and "errors" not in good.columns
    told = sorted((len(r["errors"]), r["why"]) for r in bad.collect())
    assert told == [(1, "no name"), (1, "no name"), (1, "notes must be a text"), (3, "no name")]
