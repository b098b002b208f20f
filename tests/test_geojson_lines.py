"""GeoJSON documents with a feature a line are read in splits; what isn't proven to be one is read whole."""

from __future__ import annotations

import json

import pytest

from geoloom.sources import geojson


def feature(k: int) -> str:
    return json.dumps({"type": "Feature", "id": k, "properties": {"a": k if k % 3 else None, "b": f"],}} {k}"}, "geometry": {"type": "Point", "coordinates": [k, -k]}})


FEATURES = [feature(k) for k in range(400)]
HEAD, TAIL = '{"type": "FeatureCollection", "features": [\n', "\n]}\n"
NESTED = '{"type": "FeatureCollection", "features": [' + FEATURES[0] + '], "more": [\n'


@pytest.fixture
def small_splits(spark):
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8192")
    yield
    spark.conf.unset("spark.sql.files.maxPartitionBytes")


@pytest.mark.parametrize(
    ("text", "by_lines"),
    [
        (HEAD + "\n,".join(FEATURES) + TAIL, True),
        (HEAD + ",\n".join(FEATURES) + TAIL, True),
        ('{\n"type": "FeatureCollection",\n"crs": {"type": "name"},\n"features": [\n' + " ,\r\n\r\n\t".join(FEATURES) + "\n],\n\"x\": 1\n}", True),
        (HEAD + FEATURES[0] + TAIL, True),
        (HEAD + ",".join(FEATURES) + TAIL, False),  # all on one line
        (json.dumps(json.loads(HEAD + ",".join(FEATURES) + TAIL), indent=1), False),
        (NESTED + ",\n".join(FEATURES[1:]) + TAIL, False),  # the lines are another list's
        (FEATURES[0] + "\n", False),
    ],
)
def test_same_features(spark, small_splits, tmp_path, text, by_lines):
    path = tmp_path / "a.geojson"
    path.write_text(text, newline="")
    assert (geojson._by_lines(spark, f"file://{path}") is not None) == by_lines
    df = geojson.read(spark, f"file://{path}").df
    doc = json.loads(text)
    want = [(f["id"], f["properties"]["a"], f["properties"]["b"]) for f in doc.get("features", [doc])]
    assert df.columns == ["fid", "a", "b", "geom", "env"]
    assert sorted(((r["fid"], r["a"], r["b"]) for r in df.select("fid", "a", "b").collect()), key=lambda r: r[0]) == [(k, a if df.schema["a"].dataType.typeName() != "string" else a and str(a), b) for k, a, b in want]
    if by_lines and len(want) > 1:
        assert df.rdd.getNumPartitions() > 1


@pytest.mark.parametrize(
    "text",
    [
        HEAD + "\n".join(FEATURES[:3]) + TAIL,  # no commas
        HEAD + ",\n".join(FEATURES[:3]) + "," + TAIL,  # one too many
        HEAD + f"{FEATURES[0]},\n{FEATURES[1]}\n{FEATURES[2]}\n" + TAIL,
        HEAD + ",\n".join(FEATURES[:3]),  # cut off
        HEAD + ",\n".join([*FEATURES[:3], "{", FEATURES[4]]) + TAIL,
    ],
)
def test_broken_documents_are_refused(spark, tmp_path, text):
    path = tmp_path / "a.geojson"
    path.write_text(text)
    with pytest.raises(Exception, match="JSONDecodeError"):
        geojson.read(spark, f"file://{path}").df.collect()


def test_long_documents_of_another_layout(spark, tmp_path):
    """The proof is given up early, with input left, and the document is read whole."""
    path = tmp_path / "a.geojson"
    path.write_text(json.dumps({"type": "FeatureCollection", "features": [json.loads(feature(k)) for k in range(6000)]}, indent=1))
    df = geojson.read(spark, f"file://{path}").df
    assert df.count() == 6000 and df.selectExpr("sum(fid)").first()[0] == sum(range(6000))
