"""The last stage of the pipeline keeps the token ids."""

import json
from pathlib import Path

import pytest

from lodestar.llm import bpe, stages
from lodestar.llm.queries import vocabulary_path


def test_bpe_stage_keeps_ids(spark):
    docs = spark.createDataFrame([(1, "some words, and more"), (2, None)], "doc_id long, text string")
    got = {r.doc_id: r for r in stages.bpe_stage(spark, docs, "").collect()}
    assert bpe.loaded(vocabulary_path()).encode_batch(["some words, and more"])[0] == b"".join(i.to_bytes(4, "little") for i in got[1].ids)
    assert got[2].ids == [] and got[1].n_tokens == len(got[1].ids)


def test_other_kinds_of_vocabulary_are_an_error(tmp_path):
    spec = json.loads(Path(vocabulary_path()).read_text())
    for change in ({"normalizer": {"type": "NFC"}}, {"pre_tokenizer": {"type": "Whitespace"}}, {"pre_tokenizer": spec["pre_tokenizer"] | {"add_prefix_space": True}}, {"model": spec["model"] | {"unk_token": "x"}}, {"added_tokens": [spec["added_tokens"][0] | {"lstrip": True}]}):
        (tmp_path / "v.json").write_text(json.dumps(spec | change))
        with pytest.raises(ValueError):
            bpe.ByteBpe(str(tmp_path / "v.json"))
