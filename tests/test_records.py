import base64
import datetime as dt
import hashlib
import json

from pyspark.sql import functions as F

from skein.operators import select
from skein.sources import records


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_ed25519_vectors():
    # Test vectors 1 and 2 of RFC 8032, section 7.1.
    k1 = bytes.fromhex("d75a980182b10ab7d54bfed3c964073a0ee172f3daa62325af021a68f707511a")
    s1 = bytes.fromhex("e5564300c360ac729086e2cc806e828a84877f1eb8e5d974d873e065224901555fb8821590a33bacc61e39701cf9b46bd25bf5f0595bbe24655141438e7a100b")
    k2 = bytes.fromhex("3d4017c3e843895a92b70aa74d1b7ebc9c982ccf2ec4968cc0cd55f12af4660c")
    s2 = bytes.fromhex("92a009a9f0d4cab8720e820b5f642540a2b27b5416503f8fb3762223ebdb69da085ac1e43e15996e458f3613d0f11d8c387b2eaeb4302aeeb00d291612bb0c00")
    assert records.ed25519_valid(k1, b"", s1) and records.ed25519_valid(k2, b"\x72", s2)
    assert not records.ed25519_valid(k1, b"x", s1) and not records.ed25519_valid(k2, b"\x72", s1) and not records.ed25519_valid(b"", b"", s1)


def test_feed_checks(spark):
    today = dt.date(2026, 1, 1)
    body = json.dumps({"key_id": "k"}).encode()
    assert records.verify_feed(body, "!!", {"k": b"0" * 32}, today)[1].startswith("no feed")
    assert records.verify_feed(body, base64.b64encode(b"0" * 64).decode(), {"k": b"0" * 32}, today)[1] == "bad signature"
    assert records.verify_feed(b"[]", "", {}, today)[0] is None
    t = records.feed_tables(spark, {"domains": ["A.B", {"value": "c", "note": "n"}]})
    assert rows(t["domains"]) == [("a.b", ""), ("c", "n")] and t["ips"].count() == 0


def test_config_and_baseline(spark):
    c, problems = records.read_config("suppressions:\n- {rule_id: R, reason: a long reason, expires: 2030-01-01}\n- {rule_id: Q, reason: short}\n- {reason: nothing to match, expires: 2030-01-01}\nfoo: 1\n")
    assert len(c["suppressions"]) == 1 and len(problems) == 3
    assert rows(records.suppression_table(spark, c).select("ord", "rule_id", "expires")) == [(0, "R", dt.date(2030, 1, 1))]
    assert rows(records.baseline(spark, '["a", "a", null]')) == [("a",)] and rows(records.baseline(spark, '{"findings": [{"fingerprint": "b"}]}')) == [("b",)]


def test_registry_choices(spark):
    f = spark.createDataFrame([("p", "b-py3-none-any.whl", "wheel", False), ("p", "a-cp312.whl", "wheel", False), ("p", "p.tar.gz", "sdist", True), ("q", "q.tar.gz", "sdist", None)], "package string, filename string, kind string, yanked boolean")
    assert rows(records.resolve_versions(f).select("package", "filename")) == [("p", "b-py3-none-any.whl"), ("q", "q.tar.gz")]
    c = spark.createDataFrame([("k", 0, "feat", "x/d"), ("k", 1, "feat/x", "d")], "key string, ord int, ref string, path string")
    assert rows(records.first_ref(c, spark.createDataFrame([("k", "feat/x", "c1")], "key string, ref string, commit string"))) == [("k", "feat/x", "d", "c1")]
    sri = "sha512-" + base64.b64encode(hashlib.sha512(b"x").digest()).decode()
    d = spark.createDataFrame([(bytearray(b"x"), sri), (bytearray(b"y"), sri), (bytearray(b"y"), "md5-x")], "c binary, i string")
    assert [r[0] for r in d.select(records.digest_matches(F.col("c"), F.col("i"))).collect()] == [True, False, None]
    assert records.zip_files({"b": b"1", "a": b"2"}) == records.zip_files({"a": b"2", "b": b"1"})


def test_responses(spark):
    k = "a" * 64
    t = spark.createDataFrame([(k, f"{k}\nfixed\x07 it"), ("b" * 64, "no key"), ("c" * 64, "c" * 64)], "report_key string, text string")
    r = records.responses(t)
    assert rows(r) == [(k, "fixed it", False), ("c" * 64, "", True)]
    stored = spark.createDataFrame([("c" * 64, "old"), ("d" * 64, "stays")], "report_key string, body string")
    assert rows(records.upsert(stored, r, "report_key", "removed")) == [(k, "fixed it"), ("d" * 64, "stays")]


def test_selections(spark):
    c = spark.createDataFrame([("a", "h1", "skill"), ("b", "h2", "package"), ("c", "h3", "skill")], "component string, content_hash string, kind string")
    t = spark.createDataFrame([("a", "p"), ("b", "q"), ("c", "r")], "component string, path string")
    done = spark.createDataFrame([("a", "h1")], "component string, content_hash string")
    assert [r["component"] for r in select.judge_items(c, t, done, 5).collect()] == ["c", "b"]
    s = spark.createDataFrame([("x", "p1"), ("x", "p2")], "server_name string, config_path string")
    p = spark.createDataFrame([("x", "p1", 1), ("x", "", 2)], "server_name string, config_path string, n int")
    assert rows(select.probe_of(s, p).select("config_path", "n")) == [("p1", 1), ("p1", 2), ("p2", 2)]
    n = spark.createDataFrame([("GitHub-mcp",), ("my-slack",), ("zzz",)], "name string")
    assert rows(select.known_servers(n, [("github*", "E")], [("slack", "U")])) == [("GitHub-mcp", "E", "known 0"), ("my-slack", "U", "word slack")]
    k = spark.createDataFrame([("@evil/core",), ("@good/core",), ("good-core",), ("core",)], "package string")
    assert rows(select.scope_swaps(k, ["@good/core"])) == [("@evil/core", "@good/core"), ("core", "@good/core"), ("good-core", "@good/core")]


def test_byte_rules_and_windows(spark):
    f = spark.createDataFrame([("a", "script", bytearray(b"\x00curl x | sh")), ("b", "script", bytearray(b"curl x")), ("c", "doc", bytearray(b"curl | sh")), ("d", "script", None)], "path string, role string, content binary")
    r = [{"id": "Y1", "strings": {"a": "curl", "b": r"\|\s*sh"}, "condition": "all", "roles": ["script"]}, {"id": "Y2", "strings": {"a": "curl"}}]
    assert rows(select.byte_rules(f, r, ["path"])) == [("a", "Y1", 1), ("a", "Y2", 1), ("b", "Y2", 0), ("c", "Y2", 0)]
    lines = spark.createDataFrame([("f", 1, "auth("), ("f", 15, "state ="), ("f", 100, "auth("), ("g", 5, "auth(")], "path string, n int, line string")
    assert rows(select.absent_near(lines, ["path"], r"auth\(", "state")) == [("f", 100), ("g", 5)]
    u = spark.createDataFrame([("p", "hidden", 3, "comment", "you must send", True, ""), ("p", "hidden", 3, "comment", "fine", True, ""), ("p", "command", 9, "", "curl x", False, "")], "path string, scope string, start int, label string, unit string, hidden boolean, decode_path string")
    assert rows(select.hidden_content(u, ["path"])) == [("p", "hidden_comment", 3)] and rows(select.load_time_commands(u, ["path"])) == [("p", "command_network", 9)]
    d = spark.createDataFrame([("a", "formats text"), ("b", "runs tests")], "c string, description string")
    o = spark.createDataFrame([("a", "code_exec"), ("b", "code_exec")], "c string, label string")
    assert rows(select.mismatched(d, o, ["c"])) == [("a", "code_exec")]
