import hashlib
import io
import wave

import duckdb
import numpy as np
import pytest
import pyarrow as pa

from brindle.llm import audio, html_extract, warc


def test_wav_holds_the_payload(spark, awkward, no_docs):
    rows = {(r["doc_id"], r["n_bytes"]): r for r in audio.store_and_describe(awkward, keep_tensors=True).collect()}
    for r in awkward.collect():
        data = (r["text"] or "").encode()
        padded = data + b"\0" * (-len(data) % 64 if data else 64)
        got = rows[r["doc_id"], len(data)]
        assert got["payload_bytes"] == len(padded) and got["payload_sha256"] == hashlib.sha256(padded).hexdigest()
        with wave.open(io.BytesIO(audio.wav(padded))) as w:
            assert w.readframes(w.getnframes()) == padded and w.getsampwidth() == 1
        table = pa.ipc.open_stream(got["tensors"]).read_all()
        assert table.schema.field("log_mel").type.shape == [audio.TENSOR_FRAMES, audio.MELS]
        assert table["start_ms"][0].as_py() == 0 and len(table) == -(-audio.frame_count(len(padded)) // audio.TENSOR_FRAMES)
    assert rows[0, len(awkward.where("doc_id = 0").first()["text"])]["feature"] == rows[1, len(awkward.where("doc_id = 1").first()["text"])]["feature"]
    assert audio.store_and_describe(no_docs).count() == 0


def test_resampler_does_not_depend_on_blocks():
    pcm = np.random.default_rng(0).integers(0, 256, 5000, dtype=np.uint8)
    whole = audio.resample(pcm, 0, 2500)
    parts = np.concatenate([audio.resample(pcm, a, a + 500) for a in range(0, 2500, 500)])
    assert np.allclose(whole, parts, atol=1e-6)
    phases = audio._phases(3, 4, 16)
    t = np.arange(3000)
    tone = (128 + 100 * np.sin(t * 0.05)).astype(np.uint8)
    y = audio.resample(tone, 300, 1500, 3, 4, phases)
    want = 100 / 128 * np.sin((np.arange(300, 1500) * 4 / 3) * 0.05)
    assert max(np.corrcoef(y[k : 1100 + k], want[:1100])[0, 1] for k in range(-0, 20)) > 0.99


def test_segments():
    energy = np.array([0, 0, 0.5, 0.9, 0.5, 0.45, 0, 0.5, 0.5, 0, 1.0])
    assert audio.segments(energy) == [(2, 6), (10, 11)]
    assert audio.segments(np.zeros(5)) == []


def test_all_segments_and_tensors_are_kept(spark, awkward):
    loud, quiet = bytes([0, 255] * 1000 + [60, 200, 255, 10] * 500), bytes([128] * 4000)
    pcm = np.frombuffer((quiet + loud) * 9, np.uint8)
    stream, frames, found = audio.analyse(pcm)
    assert frames == audio.frame_count(len(pcm)) and len(found) == 9
    text = dict(p.split("=") for p in audio.describe(stream, frames, found).split(";"))
    assert text["spans"] == ",".join(f"{audio._ms(a)}-{audio._ms(b)}" for a, b in found) and text["segments"] == "9"
    mel = np.concatenate([m for m, _ in audio.log_mel(pcm)])
    assert np.array_equal(audio.stored_mel(stream, frames), mel)
    stored = audio.audio_tensors(audio.encode_media(awkward))
    for r in audio.audio_features(stored, keep_tensors=True).collect():
        text = dict(p.split("=") for p in r["feature"].split(";"))
        assert len([x for x in text["spans"].split(",") if x]) == int(text["segments"])
        assert len(audio.stored_mel(r["tensors"], int(text["frames"]))) == int(text["frames"])
    many = spark.createDataFrame([(1, ("\x7f" * 4000 + " " * 4000) * 9)], "doc_id long, text string")
    assert [len(r["starts"]) for r in audio.audio_tensors(audio.encode_media(many)).collect()] == [9]


PAGES = "page_id long, url string, html string, block long, path string, n int"


def test_warc_round_trip(spark, sf):
    trap = "WARC/1.1\r\nContent-Length: 10\r\n\r\nabcdefgh\r\n\r\nWARC/1.0\r\nfoo: bar\r\n\r\n"
    own = [(r["page_id"], r["url"], r["html"], 1, "p", 1) for r in spark.read.parquet(f"{sf}/pages.parquet").collect()]
    odd = [(5000, None, None, 1, "p", 1), (5001, "u\nv", "", 1, "p", 1), (5002, "x", trap, 1, "p", 1), (5003, "y", trap * 40, 1, "p", 1)]
    copies = [(i + 1000, u, h, 1, "p", 1) for i, u, h, *_ in own[::3]]
    pages = spark.createDataFrame(own + odd + copies, PAGES).repartition(3)
    con = duckdb.connect()
    con.register("pages", pages.toPandas())
    want = sorted(con.sql(warc.ORACLE).fetchall(), key=lambda r: r[0])
    for size in (1 << 20, 3000):
        assert sorted((tuple(r) for r in warc.archive_round_trip(pages, block_bytes=size).collect()), key=lambda r: r[0]) == [tuple(r) for r in want]


def test_warc_of_awkward_pages(spark):
    pages = spark.createDataFrame([(None, "a", "x"), (1, "b", "x"), (1, "b", "x"), (2, "c", "short"), (3, "d", "short")], "page_id long, url string, html string")
    rows = sorted((r["page_id"] or 0, r["record_type"], r["refers_to"]) for r in warc.archive_round_trip(pages, min_bytes=0).collect())
    assert rows == [(0, "revisit", 1), (1, "response", None), (1, "response", None), (2, "response", None), (3, "revisit", 2)]
    assert {r["record_type"] for r in warc.archive_round_trip(pages, min_bytes=100).collect()} == {"response"}
    assert warc.archive_round_trip(pages.where("page_id > 9")).count() == 0


@pytest.fixture(scope="module")
def extractor():
    return html_extract.fit_extractor()


def test_main_text(spark, sf, extractor):
    import html
    import re

    pages = spark.read.parquet(f"{sf}/pages.parquet")
    got = {r["page_id"]: r for r in html_extract.extract_main_text(pages, extractor).collect()}
    for p in pages.collect():
        article = re.search(r"<article>(.*?)</article>", p["html"], re.S)[1]
        parts = [" ".join(html.unescape(re.sub(r"<[^>]*>", " ", x)).split()) for x in re.split(r"</?(?:p|h1)>", article)]
        want = "\n".join(x for x in parts if x)
        assert got[p["page_id"]]["text"] == want and got[p["page_id"]]["n_chars"] == len(want)
    odd = spark.createDataFrame([(1, None, None, 1, "p", 1), (2, "u", "", 1, "p", 1), (None, "u", "<<p <b", 1, "p", 1), (4, "u", "<p>" * 3000, 1, "p", 1)], PAGES)
    assert [r["text"] for r in html_extract.extract_main_text(odd, extractor).orderBy("page_id").collect()][1:] == ["", "", ""]
    held, found, right = 0, 0, 0
    for source in html_extract.training_pages(60, seed=99):
        page = html_extract.Page(source)
        labels = ["n" if not (m := html_extract.LABEL.search(a)) else m[1] for a in page.attrs]
        for i in range(1, len(labels)):
            if labels[page.parent[i]] == "b":
                labels[i] = "b"
        x = html_extract.node_features(page)
        c, b = extractor.content.proba(x), extractor.boiler.proba(x)
        scale = np.maximum(1, c + b)
        chosen = html_extract.decode(page, c / scale, b / scale)
        for i in range(1, len(labels)):  # no contradictions
            above = chosen[page.parent[i]]
            assert not (above == html_extract.BOILER and chosen[i] != html_extract.BOILER) and not (above == html_extract.CONTENT and chosen[i] == html_extract.NEUTRAL)
        for owner, t in page.blocks:
            held += len(t) * (labels[owner] == "c")
            found += len(t) * (chosen[owner] == html_extract.CONTENT)
            right += len(t) * (labels[owner] == "c" and chosen[owner] == html_extract.CONTENT)
    assert right / held > 0.97 and right / found > 0.97


P = "A sentence of some length, with words that say a thing or two about the river and the bridge. "


def test_tokens_of_odd_markup(extractor):
    pages = {
        f"<article><h1>Title</h1><p>{P}</p><button-group>x</button-group><p>{P}two</p></article>": ["Title", P.strip(), P + "two"],
        f"<article><h1>Title</h1><p>{P} <button>Share</p><p>{P}rest</p></article>": ["Title", P.strip(), P + "rest"],
        f"<article><p title=it's>{P}</p><p>{P} it's two</p></article>": [P.strip(), P + "it's two"],
        f"<div><h1>Title</h1><p>{P * 2}</p><p>{P * 3}</p></div>": ["Title", (P * 2).strip(), (P * 3).strip()],
        f"<table><tr><td><h1>Title</h1><p>{P * 2}</p><p>{P * 3}</p></td></tr></table>": ["Title", (P * 2).strip(), (P * 3).strip()],
        f"<article><p>one {P}<svg class='i'/> two</p><p>three {P}</p></article>": [f"one {P}two", f"three {P}".strip()],
        f"<html><head><title>T</title><p>{P * 2}</p><p>{P}</p>": [(P * 2).strip(), P.strip()],
        f"<article><script>if (a<b) x='</p>';</script><p>{P * 2}</p><style>p{{}}</style><p>{P}</p></article>": [(P * 2).strip(), P.strip()],
        f"<article><!-- x > y --><p>{P * 2} a < b &amp; c</p></article>": [P * 2 + "a < b & c"],
    }
    for source, text in zip(pages, extractor.extract(list(pages))):
        kept = text.split("\n")
        assert [t for t in kept if t != "x"] == pages[source], source


def test_long_odd_pages_take_linear_time():
    import time

    began = time.time()
    for part in ("<a ", "<a href='", "<button>", "<script>", "<!-- ", "</b", "<svg>", "</button>", "<p a=\"b'>"):
        html_extract.Page(part * 40_000)
    assert time.time() - began < 30
