"""Archives: round trip, roles of equal payloads, and what other readers need."""
import base64
import hashlib
import glob

import zstandard

from tierflow.llm import warc

SCHEMA = "page_id long, url string, html string, payload string, response long"


def rows():
    page = "<html><body>" + "some text that pages share " * 30
    out = [(i, f"http://h{i % 3}.example/{i}", f"{page}{i // 2}</body></html>", "p", 1) for i in range(60)]
    out += [(100, None, None, None, None), (101, "http://a\r\nb", "", "p", 2), (None, "http://n", "no id", "p", 3),
            (102, "u", "é漢" * 5000, "p", 3), (102, "u", "é漢" * 5000, "p", 3), (None, "http://m", f"{page}3</body></html>", "p", 3)]
    return out


def expected(data, least=0):
    top = {}
    for i, _, h, *_ in data:
        top[h or ""] = max(top.get(h or "", -1), -1 if i is None else i)
    out = []
    for i, _, h, *_ in data:
        b = (h or "").encode()
        first = (-1 if i is None else i) == top[h or ""] or len(b) < least
        out.append((i, len(b), base64.b32encode(hashlib.sha1(b).digest()).decode(),
                    "response" if first else "revisit", None if first else top[h or ""]))
    return out


def test_round_trip(spark, tmp_path):
    data = rows()
    pages = spark.createDataFrame(data, SCHEMA)
    for least in (0, 20):
        path = str(tmp_path / f"a{least}")
        warc.write_archives(pages.repartition(1 + least), path, least)
        got = warc.read_archives(spark, path, with_payload=True).collect()
        assert sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got), key=str) \
            == sorted(expected(data, least), key=str)
        text = {h for _, _, h, *_ in data}
        assert {(r.payload or b"").decode() for r in got if r.record_type == "response"} == {t or "" for t in text}


def test_archives_are_plain_zstandard_with_the_dictionary_in_front(spark, tmp_path):
    path = str(tmp_path / "a")
    warc.write_archives(spark.createDataFrame(rows(), SCHEMA), path)
    records = 0
    for name in glob.glob(path + "/part-*"):
        data = open(name, "rb").read()
        frames = list(warc.split_frames(data))
        if not frames:
            continue
        assert data[:4] == warc.DICTIONARY_FRAME.to_bytes(4, "little")
        dictionary = frames[0][0]
        assert dictionary[:4] == bytes.fromhex("37a430ec")
        # a stream decoder given the dictionary reads all members, skipping the empty frames
        d = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(dictionary))
        whole = d.stream_reader(data, read_across_frames=True).read()
        assert whole.count(b"WARC/1.1\r\n") == len(frames)
        records += len(frames)
    assert records == len(rows())


def test_empty_table(spark, tmp_path):
    path = str(tmp_path / "a")
    warc.write_archives(spark.createDataFrame([], SCHEMA), path)
    assert warc.read_archives(spark, path).count() == 0


def test_dictionary_sample_is_of_records_as_written(spark, tmp_path, monkeypatch):
    """A payload that most pages share is in the sample once, its revisits without it."""
    seen = []
    train = zstandard.train_dictionary
    monkeypatch.setattr(zstandard, "train_dictionary", lambda size, samples: seen.extend(samples) or train(size, samples))
    hot = "<p>hot payload</p>" * 40
    data = [(i, f"http://h/{i}", hot if i % 3 else f"<p>page {i}</p>" * 40, "p", 1) for i in range(150)]
    warc.write_archives(spark.createDataFrame(data, SCHEMA), str(tmp_path / "a"))
    assert len(seen) == 150
    assert sum(hot.encode() in x for x in seen) == 1
    assert sum(b"WARC-Type: revisit" in x for x in seen) == 99
