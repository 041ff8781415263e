"""What the reading of a page works out once or not at all, and that the cheaper forms give what the plain ones gave."""

from tests_support import S, site_archive

from shelfscan.functions import markup as M
from shelfscan.functions import scalars
from shelfscan.functions import variants as V
from shelfscan.functions.sql import lit, replaced
from shelfscan.sources.archive import store_responses

BLANK_PATTERN = r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+\z"


def test_strip_trims_what_the_pattern_trimmed(spark):
    texts = [(f"{c}{c}a{c}b{c}",) for c in map(chr, range(1, 0x10000)) if not c.isalnum() and not 0xD800 <= ord(c) < 0xE000]
    texts += [("",), (" \t　",), (None,), ("\U0001f600 x \U0001f600",), ("  é \n",)]
    rows = spark.createDataFrame(texts, "s STRING").selectExpr("s", f"{scalars.py_strip('s')} AS new", f"{replaced('s', BLANK_PATTERN, '')} AS old")
    assert rows.filter("NOT new <=> old").collect() == []
    assert "regexp" not in scalars.py_strip("s")


def test_values_are_read_once(ev):
    text = V.scalar_text("v")
    assert text.count("schema_of_variant") == 1 and text.count("'string'") == 1
    shown = {
        '"x "': "x", '""': None, "5": "5", "0": None, "0.0": None, "1.5": "1.5", "2.0": "2.0", "1e3": "1000.0", "true": "True",
        "false": None, "null": None, "[]": None, "{}": None, "[1]": "[1]", '{"a":1}': '{"a":1}', '"false"': "false", '"[]"': "[]",
    }
    for value, expected in shown.items():
        assert ev(V.scalar_text(f"parse_json({lit(value)})")) == expected, value
        assert ev(V.truthy(f"parse_json({lit(value)})")) is (expected is not None), value


def test_outermost_level_tells_objects_and_lists(ev):
    assert "schema_of_variant" not in V.is_object("v") + V.is_array("v")
    for value, kind in {"{}": "o", '{"a":{"b":[1]}}': "o", "[]": "a", '[{"a":1},2]': "a", '"{}"': "", "1": "", "null": "", "true": ""}.items():
        v = f"parse_json({lit(value)})"
        assert (ev(V.is_object(v)), ev(V.is_array(v))) == (kind == "o", kind == "a"), value
    nothing = "CAST(NULL AS VARIANT)"
    assert (ev(V.is_object(nothing)), ev(V.is_array(nothing))) == (False, False)


def test_blocks_and_tags_are_found_as_by_plain_alternatives(ev):
    html = (
        "a<!-- <b> --><SCRIPT a='>'>x<b></script >y<style>p{}</Style><p class='a>b'>t</p><br/><!doctype x><?pi>< b <5 <scripty>z</scripty>"
        "<a b=\"c>d>e</a><!---->f<p\n x=1>g<!-- open <style>q"
    )
    plain = {
        M.RAW_BLOCK: f"(?is){M._COMMENT}|{M._SCRIPT}|{M._STYLE}",
        M.COMMENT_OR_SCRIPT: f"(?is){M._COMMENT}|{M._SCRIPT}",
        M.TAG: f"(?is){M._TAG}",
    }
    for pattern, was in plain.items():
        assert pattern.startswith("(?is)<(?:")
        for cut in range(0, len(html), 7):
            assert ev(replaced("h", pattern, "|"), h=html[cut:]) == ev(replaced("h", was, "|"), h=html[cut:]), (pattern, cut)


def test_responses_of_some_urls(spark):
    archive = store_responses(site_archive(spark), buckets=3)
    some = spark.createDataFrame([(S, S + "/p/1"), (S, S + "/p/1"), (S, S + "/nowhere")], "site STRING, url STRING")
    got = archive.responses(of=some).collect()
    assert got == archive.responses().filter(f"url = '{S}/p/1'").collect() and len(got) == 1
