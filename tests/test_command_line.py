"""ask and calibrate with models that are given by name."""

import json
import sys
import types

import pytest

from tessera.__main__ import main
from tessera.plans import ingest
from tessera.sources.store import Store

S = "The value shall be recorded after drying for one hour at the stated temperature in a clean oven."


def test_ask_and_calibrate(spark, tmp_path, monkeypatch, capsys):
    def embed(texts):
        return [[float(t.lower().count(c)) + 0.01 for c in "abcdefgh"] for t in texts]

    models = types.ModuleType("fake_models")
    models.embed, models.translate = embed, lambda prompts: prompts
    models.generate = lambda prompts: ["The value is recorded after drying for one hour, as the passage says."] * len(prompts)
    monkeypatch.setitem(sys.modules, "fake_models", models)
    for name, value in (("EMBED_DIMS", "8"), ("SIMILARITY_THRESHOLD", "0.2"), ("SOFT_THRESHOLD", "0.1"), ("BRIDGE_FLOOR", "0.05")):
        monkeypatch.setenv(name, value)
    store = str(tmp_path / "s")
    raw = spark.createDataFrame([(d, f"{d}.pdf", 1, "\n".join(f"{S} {d}{k}." for k in range(4))) for d in ("x", "y")], "doc_id string, source_file string, page_number int, text string")
    ingest.index_pages(raw, Store(spark, store, keywords=True), embed, 8)
    main(["ask", store, "what value is recorded after drying", "hello", "--models", "fake_models"], spark)
    out = capsys.readouterr().out
    assert "answered (answer): The value is recorded" in out and "hello\n  chitchat" in out
    probes = tmp_path / "probes.json"
    probes.write_text("\n".join(json.dumps({"query": q, "label": label}) for q, label in (("value of drying", "in"), ("zzz", "out"), ("recorded temperature", "in"))))
    main(["calibrate", store, "--models", "fake_models", "--probes", str(probes)], spark)
    out = capsys.readouterr().out
    assert "overlapping" in out and "median" in out
    with pytest.raises(SystemExit, match="--models"):
        main(["ask", store, "what"], spark)
