import json
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from strandlake.llm import common, token_files

PATH = public_tokenizers.path("byte_bpe_50k.json")


def expected(rows):
    t = Tokenizer.from_file(PATH)
    at, out = 0, []
    for doc_id, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "")):
        ids = t.encode(text or "", add_special_tokens=False).ids + [token_files.END_ID]
        out.append((doc_id, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    return out


def got(df):
    return sorted(map(tuple, df.drop("part").collect()), key=lambda r: r[1])


ODD = [
    (5, "a b  c   d\n e \n\n f\t g . h"),
    (3, None),
    (4, ""),
    (-1, " lead and trail "),
    (9, "x <|endoftext|> y<|endoftext|>z"),
    (7, "été naïve 　 ナ​ ́ a \x1c b \x85 c"),
    (7, "tie one"),
    (7, "tie one"),
    (None, "no id"),
    (11, "don't 'll I'm 12 345 6.7 $$$ %%% end"),
    (12, "w " * 30000 + "long" * 20000),
]


def test_round_trip_of_odd_texts(spark):
    docs = spark.createDataFrame([(d, t, "x", 1) for d, t in ODD], "doc_id long, text string, start string, part int")
    assert got(token_files.token_files(docs, PATH)) == expected(ODD)


def test_real_documents(spark):
    docs = common.table(spark, "/root/testdata/sf0.001", "documents")
    assert got(token_files.token_files(docs, PATH)) == expected([tuple(r) for r in docs.select("doc_id", "text").collect()])


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert token_files.token_files(docs, PATH).collect() == []


def test_files_have_the_stated_form(spark, tmp_path):
    docs = spark.createDataFrame([(1, "one two"), (2, "three")], "doc_id long, text string")
    out = f"file://{tmp_path}/out"
    manifest = token_files.write(docs, out, PATH)
    assert manifest == json.loads((tmp_path / "out/manifest.json").read_text())
    assert [p["base"] for p in manifest["parts"]] == list(np.cumsum([0] + [p["n_ids"] for p in manifest["parts"]])[:-1])
    files = b"".join((tmp_path / f"out/part-{p['part']:05d}.ids").read_bytes() for p in manifest["parts"])
    t = Tokenizer.from_file(PATH)
    want = [i for x in ("one two", "three") for i in t.encode(x).ids + [2]]
    assert np.frombuffer(files, manifest["dtype"]).tolist() == want


@pytest.mark.parametrize("most", [3, 10**6])
def test_memory_of_pieces_does_not_change_ids(most, monkeypatch):
    monkeypatch.setattr(token_files, "REMEMBER", most)
    e, t = token_files.Encoder(PATH), Tokenizer.from_file(PATH)
    texts = [x or "" for _, x in ODD] * 2
    for _ in range(2):
        assert [np.frombuffer(b, e.dtype).tolist() for b in e.encode(texts)] == [x.ids for x in t.encode_batch(texts, add_special_tokens=False)]
