"""Mixing, personal data, archives, audio, SimHash and the pipeline, against brute force."""

import gzip
import hashlib
import io
import os
import re
import zipfile
import zlib

import duckdb
import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from tessera.llm import audio, mixing, pii, queries, simhash, spans, zipwarc


def duck(sf, sql):
    con = duckdb.connect()
    for t in ("documents", "pages", "labels"):
        path = f"{sf}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    return con.sql(sql)


def test_mix_equals_sql(spark):
    sf = "/root/testdata/sf0.01"
    got = sorted(map(tuple, queries.op2_mixing(spark, sf).collect()))
    want = sorted(duck(sf, mixing.ORACLE).fetchall())
    assert got == want


def test_mix_meets_targets(spark, sf):
    rows = queries.op2_mixing(spark, sf).join(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "source"), "doc_id").collect()
    assert all(0 <= r.taken <= 2 * r.size for r in rows)
    for source in {r.source for r in rows}:
        own = [r for r in rows if r.source == source]
        assert sum(r.taken for r in own) == pytest.approx(own[0].target, rel=0.02)


def test_targets_fill_up_to_the_limit(spark):
    sized = spark.createDataFrame([("a", 100), ("b", 100_000), ("c", 5_000), (None, 0)], "source string, size long")
    rows = {r.source: r.target for r in mixing.targets(sized).collect()}
    assert rows["a"] == 200 and rows[None] == 0 and rows["c"] == 10_000
    assert sum(rows.values()) == pytest.approx(1.5 * 105_100)


def test_mix_of_odd_rows(odd, nothing):
    rows = mixing.mix(odd).collect()
    assert len(rows) == 11 and all(r.taken == 0 for r in rows if r.size == 0) and all(r.taken <= 2 * r.size for r in rows)
    assert sorted(map(str, rows)) == sorted(map(str, mixing.mix(odd).collect()))
    assert mixing.mix(nothing).count() == 0 and mixing.copies(nothing).count() == 0
    assert mixing.copies(odd).columns == odd.columns
    clash = odd.withColumn("key", F.lit(1)).withColumn("share", F.lit(2)).withColumn("copy", F.lit(3)).withColumn("times", F.lit(4))
    assert mixing.copies(clash).columns == clash.columns and mixing.copies(clash).filter("key = 1 AND share = 2 AND copy = 3").count() >= 1
    many = odd.filter("doc_id = 5 OR doc_id IS NULL").withColumn("doc_id", F.lit(None).cast("long"))
    for _ in range(5):
        many = many.unionByName(many.withColumn("text", F.concat("text", F.lit(" more"))))
    words = lambda df: df.select(F.sum(mixing.words(F.col("text")))).first()[0]
    assert abs(words(mixing.copies(many)) / words(many) - 1.5) < 0.3


EMAIL, IP = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"
CARD, PHONE = r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]"


def brute_pii(t):
    def luhn(s):
        return sum((d := int(c) * (1 + i % 2)) - 9 * (d > 9) for i, c in enumerate(reversed(s))) % 10 == 0

    n = lambda m: re.sub("[^0-9]", "", m[0])
    t = t or ""
    found = [("email", m) for m in re.finditer(EMAIL, t)]
    found += [("ip", m) for m in re.finditer(IP, t) if all(int(p) <= 255 for p in m[0].split("."))]
    found += [("card", m) for m in re.finditer(CARD, t) if 12 <= len(n(m)) <= 19 and luhn(n(m))]
    found += [("phone", m) for m in re.finditer(PHONE, t) if 9 <= len(n(m)) <= 15]
    return sorted(((k, m.start(), m.end()) for k, m in found), key=lambda s: (s[1], pii.KINDS.index(s[0])))


TRICKY = [
    "a@b.c%x@d.e f@g x.y@z-1.co.uk, @no.user a%b@c", "1.2.3.4.5.6.7.8 256.1.1.1 000255.0.0.01 1.2.3 9.9.9.9999999999999999999", "4111-1111 1111-1111 4111111111111112 0000 0000 0000 4-2",
    "+1 (408) 555-7800 +12 +1+2+3+4 +123456789 ++49 30 1234567. +1234567890123456", "été\U0001f600 a@b.co \U0001f600 10.0.0.1", "1 " * 30, "x" * 20_000, "a." * 5_000, "7" * 20_000, "a@b" + ".c" * 4_000, "+1" + " " * 5_000, "11 22 " * 3_000,
]


def test_pii_base_spans_against_brute_force(spark, sf, odd, nothing):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").unionByName(odd.select("doc_id", "text")).unionByName(spark.createDataFrame(list(enumerate(TRICKY)), "doc_id long, text string"))
    rows = pii.find(docs).select("text", *spans.digests(F.col("pii"), pii.KINDS)).collect()
    assert len(rows) == 200 + 11 + len(TRICKY)
    for r in rows:
        want = brute_pii(r.text)
        joined = [f"{k}:{a}:{b}" for k, a, b in want]
        assert r.base_sha256 == hashlib.sha256(",".join(joined).encode()).hexdigest(), r.text[:200]
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(s[0] == k for s in want) for k in pii.KINDS]
        assert set(filter(None, joined)) <= set(r.spans.split(","))
    assert pii.find(nothing).count() == 0 and pii.find(odd).columns == [*odd.columns, "pii"]


def test_pii_model_adds_likely_spans_and_redacts(spark):
    rows = [(i, f"Call me: +1 ({200 + i}) 555-{1000 + i} or write to user{i}@mail.example.com today, room {i}") for i in range(300)] + [(999, "Call me: 1 (408) 555-7800 or come, order 1234567890123456 on 2020-01-02")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = pii.find(docs)
    added = [s for r in found.collect() for s in r.pii if not s.base]
    text = rows[-1][1]
    assert [(s.kind, text[s.start : s.end]) for s in added] == [("phone", "1 (408) 555-7800")]
    clean = {r.doc_id: r.t for r in found.select("doc_id", pii.redacted(F.col("text"), F.col("pii")).alias("t")).collect()}
    assert clean[7] == "Call me: <PHONE> or write to <EMAIL> today, room 7" and "<PHONE>" in clean[999]


@pytest.mark.parametrize("share", [10, 2])
def test_pii_adds_disguised_addresses_however_common(spark, share):
    def row(i):
        at, dot = (" (at) ", [" (dot) ", "[dot]"][i // share % 2]) if i % share == 0 else ("@", ".")
        return i, f"Please write to user{i}{at}mail{dot}example{dot}com today, or look for me @ home or {i % 7}[at]x, room {i}"

    rows = [row(i) for i in range(600)]
    found = pii.find(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    for r in found:
        address = re.search(r"user.*?com", r.text)
        assert [(s.kind, s.start, s.end, s.base) for s in r.pii] == [("email", *address.span(), r.doc_id % share > 0)]


def brute_added(text, model):
    """Candidates, features and verdicts of the wider generators, in plain Python."""
    base, out = brute_pii(text), []
    signs = {"email": [(r" ?[(\[]at[)\]] ?", "@"), (r" ?[(\[]dot[)\]] ?", ".")], "ip": [(r" ?[(\[](?:\.|dot)[)\]] ?", ".")], "card": [(r"[ ./_-]{2,3}|[./_]", "-")], "phone": []}

    def luhn(d):
        return sum((x := int(c) * (1 + i % 2)) - 9 * (x > 9) for i, c in enumerate(reversed(d))) % 10 == 0

    def side(c):
        return 0 if not c else 1 if c.isalpha() else 2 if c in " \t\n\x0b\f\r" else 3 if c in "0123456789" else 4

    for k, kind in enumerate(["email", "ip", "card", "phone"]):
        at = 0
        for m in re.finditer(pii.WIDE[kind], text or ""):
            before, after, plain = text[at : m.start()][-12:], re.split(pii.WIDE[kind], text[m.end() :])[0][:12], m[0]
            at = m.end()
            for pattern, sign in signs[kind]:
                plain = re.sub(pattern, sign, plain)
            number = re.sub("[^0-9]", "", m[0])
            if kind == "ip":
                check = 2 if re.fullmatch(r"[0-9]+(\.[0-9]+){3}", plain) and all(int(x) <= 255 for x in plain.split(".")) else 1
            else:
                check = (2 if luhn(number) else 1) if 12 <= len(number) <= 19 else 0
            cue = re.search(r"(?i)(tel|phone|call|fax|mobile|mail|contact)[^a-z0-9]*$", before) is not None
            row = (k, min(len(number), 20), min(len(plain) // 4, 12), min(plain.count("-"), 4), min(plain.count("."), 4), min(plain.count(" "), 4), min(plain.count("(") + plain.count(")"), 2), check, side(before[-1:]), side(after[:1]), int(cue))
            score = model["prior"] + pii.RATE * sum(pii.value(t, row) for t in model["trees"])
            p = 1 / (1 + np.exp(-(model["slope"] * score + model["shift"])))
            if p >= pii.REDACT_AT and not any(a < m.end() and b > m.start() for _, a, b in base):
                out.append((kind, m.start(), m.end()))
    return out


DISGUISED = [
    "write to bob (at) mail [dot] example (dot) com. Next. ip 10[.]0[.]0[.]17 or 10 (dot) 0.0.300 or 10.1.2.3, card 4111.1111.1111.1111 or 4111 - 1111 - 1111 - 1111 ok, tel (408) 555-7800x",
    "tel: 408.555.7800 call 1-800-555-0199 then 4111/1111/1111/1112 and 2020-01-02 12.30.15, 1.2.3.4.5 at a@b or c [at] d.e", " ".join(f"({i}) 555-{i:04d}," for i in range(1500)), "12 " * 4000, "x@y " * 3000,
]


def test_pii_added_spans_against_brute_force(spark, sf, odd):
    rows = [(i, f"Call: +1 ({200 + i}) 555-{1000 + i}, user{i}@mail.example.com, host 10.{i}.0.{i % 9}, card 4111-1111-1111-1111 or 4111 1111 1111 {1112 + i}, room {i}, on 2020-01-{i % 28:02d} 7:{i % 60}, 300.{i}.1.2") for i in range(200)]
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").unionByName(odd.select("doc_id", "text")).unionByName(spark.createDataFrame(rows + list(enumerate(DISGUISED)), "doc_id long, text string"))
    model = pii.fit(docs)
    added = 0
    for r in pii.find(docs, model=model).collect():
        got = [(s.kind, s.start, s.end) for s in r.pii if not s.base]
        assert sorted(got) == sorted(brute_added(r.text, model)), (r.text or "")[:200]
        assert [(s.start, pii.KINDS.index(s.kind)) for s in r.pii] == sorted((s.start, pii.KINDS.index(s.kind)) for s in r.pii)
        added += len(got)
    assert added >= 4


def test_redaction_against_brute_force(spark):
    rng = np.random.default_rng(4)
    rows = []
    for i in range(60):
        text = "".join(rng.choice(list("ab é\U0001f600"), int(rng.integers(0, 400))))
        ends = sorted({tuple(sorted(map(int, rng.integers(0, len(text) + 1, 2)))) for _ in range(int(rng.integers(0, 30)))})
        rows.append((text, [(["ip", "card"][k % 2], a, b, True, None) for k, (a, b) in enumerate(ends) if b > a]))
    out = spark.createDataFrame(rows, f"text string, s {spans.SPANS}").select("text", "s", pii.redacted(F.col("text"), F.col("s")).alias("t")).collect()
    for r in out:
        want, at = "", 0
        for s in r.s:
            if s.start >= at:
                want += r.text[at : s.start] + f"<{s.kind.upper()}>"
            at = max(at, s.end)
        assert r.t == want + r.text[at:]


def test_pii_time_grows_with_the_text(spark):
    import time

    model = {"prior": 0.0, "trees": [{"leaf": 5.0}], "slope": 1.0, "shift": 0.0}
    took = []
    for n in (100, 32_000):
        docs = spark.range(1).select(F.array_join(F.transform(F.sequence(F.lit(1), F.lit(n)), lambda i: F.concat(F.lit("+1 (408) 555-"), F.lpad(i.cast("string"), 5, "0"))), " x").alias("text"))
        began = time.time()
        row = pii.find(docs, model=model).select(F.size("pii").alias("n"), F.length(pii.redacted(F.col("text"), F.col("pii"))).alias("l")).first()
        took.append(time.time() - began)
        assert row.n >= n and row.l >= 8 * n
    assert took[1] - took[0] < 20


def test_pii_keeps_columns_of_any_name(spark):
    docs = spark.createDataFrame([(1, "a@b.co", "x", "y")], "doc_id long, text string, _base string, _wide string")
    row = pii.find(docs).first()
    assert (row._base, row._wide, row.pii[0].kind) == ("x", "y", "email")


def test_pii_plan_has_no_python(spark, sf):
    model = {"prior": 0.0, "trees": [{"leaf": 1.0}], "slope": 1.0, "shift": 0.0}
    plan = pii.find(spark.read.parquet(f"{sf}/documents.parquet"), model=model)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_archives_equal_sql_and_open_elsewhere(spark, sf):
    got = sorted(map(repr, map(tuple, queries.op6_warc(spark, sf).collect())))
    want = sorted(map(repr, duck(sf, zipwarc.ORACLE).fetchall()))
    assert got == want
    data = b"".join(zipwarc.pack([("a.txt", b"one"), ("b.bin", b"\x00" * 1000)]))
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        assert z.namelist() == ["a.txt", "b.bin"] and z.read("b.bin") == b"\x00" * 1000


class File:
    def __init__(self, data):
        self.data = data

    def size(self):
        return len(self.data)

    def read_at(self, n, at):
        return self.data[at : at + n]


def test_reader_takes_plain_and_wide_archives():
    plain = io.BytesIO()
    with zipfile.ZipFile(plain, "w") as z:
        z.writestr("x", b"hello")
        z.writestr("y", b"packed" * 50, zipfile.ZIP_DEFLATED)
        z.comment = b"a comment"
    archive = zipwarc.Archive(File(plain.getvalue()))
    assert archive.read("x") == b"hello" and "y" not in archive.members
    wide = zipwarc.Archive(File(b"".join(zipwarc.pack([("x", b"hello"), ("z", b"")]))))
    assert wide.read("x") == b"hello" and wide.read("z") == b""
    broken = bytearray(b"".join(zipwarc.pack([("x", b"hello")])))
    broken[broken.index(b"hello")] ^= 1
    with pytest.raises(ValueError):
        zipwarc.Archive(File(bytes(broken))).read("x")


def test_records_round_trip_and_revisits(spark):
    big = "é" * 60
    rows = [(3, "u", big), (1, None, big), (2, "a b\r\nc", big), (2, "again", big), (5, "s", "short"), (6, "s", "short"), (7, "n", None), (None, "z", big), (8, "e", "")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("payload", F.lit("clash")).withColumn("digest", F.lit(1))
    back = [(r.page_id, r.record_type, r.refers_to, r.payload and bytes(r.payload).decode(), r.declared_bytes) for r in zipwarc.round_trip(pages).collect()]
    want = [(3, "revisit", 1, None, 120), (1, "response", None, big, 120), (2, "revisit", 1, None, 120), (2, "revisit", 1, None, 120), (5, "response", None, "short", 5), (6, "response", None, "short", 5), (7, "response", None, None, 0), (None, "response", None, big, 120), (8, "response", None, None, 0)]
    norm = lambda xs: sorted(repr((*x[:3], x[3] or None, x[4])) for x in xs)
    assert norm(back) == norm(want)
    assert zipwarc.round_trip(pages.limit(0)).count() == 0
    same = spark.range(300).select(F.col("id").alias("page_id"), F.lit("u").alias("url"), F.lit(big).alias("html"))
    rows = zipwarc.round_trip(same.unionByName(same)).collect()
    assert len(rows) == 600 and all((r.record_type, r.refers_to) == (("response", None) if r.page_id == 0 else ("revisit", 0)) for r in rows)
    record = zipwarc.record(4, "u", b"x\r\n\r\ny", "d", None)
    assert zipwarc.parse_record(gzip.decompress(gzip.compress(record)))["payload"] == b"x\r\n\r\ny"


def test_audio_digests_against_brute_force(spark, sf, odd, nothing):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").unionByName(odd.select("doc_id", "text"))
    docs = docs.withColumn("doc_id", F.coalesce("text", F.lit("")))  # the key tells which text a row is of
    seen, n = {}, 0
    for r in audio.summarised(docs).collect():
        data = (r.doc_id or "").encode()
        full = data + b" " * (-len(data) % 192 if data else 192)
        assert (r.n_bytes, r.payload_bytes) == (len(data), len(full)) and r.payload_sha256 == hashlib.sha256(full).hexdigest()
        assert r.tail_crc32 == zlib.crc32(full[-16:]) and r.media_bytes == len(full) + 44 and r.media_sha256 == hashlib.sha256(audio.wav(full)).hexdigest()
        assert seen.setdefault(r.doc_id, r.feature) == r.feature
        n += 1
    assert n == 211 and audio.summarised(nothing).count() == 0 and audio.summarised(odd).columns[0] == "doc_id"
    assert sorted(map(repr, (r.doc_id for r in audio.summarised(odd).collect()))) == sorted(map(repr, (r.doc_id for r in odd.collect())))
    import wave

    with wave.open(io.BytesIO(audio.wav(b"\x01\x02" * 96))) as w:
        assert w.readframes(192) == b"\x01\x02" * 96 and w.getsampwidth() == 1


def test_resampling_keeps_a_tone_and_frames_match_direct_sums():
    t = np.arange(12_000) / audio.RATE
    tone = np.sin(2 * np.pi * 440 * t).astype(np.float32)
    y = audio.resample(tone)
    assert len(y) == 8_000
    spectrum = np.abs(np.fft.rfft(y[200:7_800] * np.hanning(7_600)))
    assert abs(spectrum.argmax() * audio.OUT_RATE / 7_600 - 440) < 2
    # Direct form: zeros between samples, the whole filter, every third output.
    h = np.zeros(2 * audio.TAPS * audio.DOWN + 1)
    for p in range(audio.UP):
        part = audio.PHASES[p]
        h[p :: audio.UP] = part[: len(h[p :: audio.UP])]
    up = np.zeros(2 * 600)
    up[::2] = tone[:600]
    direct = np.convolve(up, h)
    shift = min(range(40), key=lambda s: np.abs(direct[s : s + 3 * 300 : 3][:300][50:250] - y[50:250]).max())
    assert np.abs(direct[shift : shift + 3 * 300 : 3][:300][50:250] - y[50:250]).max() < 1e-4
    assert audio.segments(np.array([0, 0, 3, 1, 1, 0, 0, 0.5, 0, 0], np.float32)) == [(2, 5)]


def brute_frames(payload):
    """Log energies and power of each frame, from the definition, frame by frame."""
    x = (np.frombuffer(payload, np.uint8).astype(float) - 128) / 128
    h, taps = np.zeros(2 * audio.TAPS * audio.DOWN + 1), audio.PHASES.shape[1]
    y = np.zeros(len(x) * 2 // 3)
    for m in range(len(y)):
        at, phase = divmod(m * 3, 2)
        for k in range(taps):
            i = at + taps // 2 - k
            y[m] += audio.PHASES[phase][k] * x[i] if 0 <= i < len(x) else 0.0
    y = np.pad(y, (0, max(0, 256 - len(y))))
    window = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(256) / 256)
    mel = lambda f: 2595 * np.log10(1 + f / 700)
    edges = 700 * (10 ** (np.linspace(mel(60.0), mel(4000), 18) / 2595) - 1)
    rows, power = [], []
    for at in range(0, len(y) - 255, 128):
        f = y[at : at + 256] * window
        spectrum = [abs(sum(f * np.exp(-2j * np.pi * b * np.arange(256) / 256))) ** 2 for b in range(129)]
        own = []
        for j in range(16):
            lo, mid, hi = edges[j : j + 3]
            own.append(sum(s * max(0, min((b * 31.25 - lo) / (mid - lo), (hi - b * 31.25) / (hi - mid))) for b, s in enumerate(spectrum)))
        rows.append(np.log(np.array(own) + 1e-6))
        power.append(np.log((f * f).mean() + 1e-8))
    assert len(h) and len(rows)
    return np.array(rows), np.array(power)


def test_log_mel_frames_and_segments_against_brute_force(monkeypatch):
    text = ("quiet " * 30 + "\u00ff\u00fe\U0001f600" * 60 + " and so on, " * 25).encode()[:1920]
    for payload in (text, b" " * 192, text[:384]):
        want, power = brute_frames(payload)
        got, level = audio.frames_of(payload)
        assert got.shape == want.shape and np.allclose(got, want, atol=1e-3) and np.allclose(level, power, atol=1e-5)
        state, parts = None, []
        for i, v in enumerate(level - level.mean()):  # hysteresis, frame by frame
            if v > audio.KEEP:
                state = [i, i, False] if state is None else state
                state[1], state[2] = i + 1, state[2] or v > audio.OPEN
            if (v <= audio.KEEP or i == len(level) - 1) and state:
                parts += [(state[0], state[1])] if state[2] else []
                state = None
        assert audio.segments(level) == parts
    whole = audio.frames_of(text * 20)
    monkeypatch.setattr(audio, "STRETCH", 7)
    cut = audio.frames_of(text * 20)
    assert np.array_equal(whole[0], cut[0]) and np.array_equal(whole[1], cut[1])


def test_features_are_read_from_stored_tensors(spark, odd):
    import pyarrow.parquet as pq

    manifest = audio.stored(odd)
    files = [r.path.removeprefix("file:") for r in manifest.collect()]
    own = {}
    for path in files:
        clips, media = pq.read_table(f"{path}-clips.parquet"), pq.read_table(f"{path}-media.parquet")
        assert clips.schema.field("features").type == audio.TENSOR and audio.TENSOR.shape == [audio.CLIP_FRAMES, audio.MELS]
        for i, (key, data) in enumerate(zip(media["key"].to_pylist(), media["media"].to_pylist(), strict=True)):
            part = clips.filter(np.array(clips["row"].to_pylist()) == i)
            mels, power = audio.frames_of(audio.samples(data))
            values = part["features"].combine_chunks().to_numpy_ndarray().reshape(-1, audio.MELS)
            assert np.array_equal(values[: len(mels)], mels) and not values[len(mels) :].any() and part["begin_s"][0].as_py() == 0
            assert part["end_s"][-1].as_py() == ((len(mels) - 1) * 128 + 256) / 8000
            own.setdefault(key, set()).add(audio.feature(part))
            seconds = sum(b - a for a, b in audio.segments(power))
            assert f"frames={len(mels)};" in audio.feature(part) and f";active={seconds};" in audio.feature(part) and f";segments={len(audio.segments(power))};" in audio.feature(part)
    assert {k: set(v) for k, v in own.items()} == {k: {r.feature for r in audio.summaries(manifest).collect() if r.key == k} for k in own}
    rows = audio.clip_table(manifest).collect()
    assert all(len(r.features) == audio.CLIP_FRAMES * audio.MELS for r in rows) and sum(r.key == 2 for r in rows) == 1
    assert len(rows) == manifest.agg(F.sum("n_clips")).first()[0]


def brute_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64(s.encode(), 42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_sketch(text):
    whole = (1 << 64) - 1

    def mixed(x):
        x = (x ^ x >> 30) * 0xBF58476D1CE4E5B9 & whole
        x = (x ^ x >> 27) * 0x94D049BB133111EB & whole
        return x ^ x >> 31

    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return [0] * (simhash.SEEDS + 1)

    def shingles(width):
        out, width = [], min(width, len(words))
        for i in range(len(words) - width + 1):
            h = 0
            for w in words[i : i + width]:
                h = mixed((h * 0x9E3779B97F4A7C15 + xxhash.xxh64(w.encode(), 42).intdigest()) & whole)
            out.append(h)
        return out

    def majority(hashes):
        return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))

    return [majority([mixed((h + (k + 1) * 0x9E3779B97F4A7C15) & whole) for h in shingles(2)]) for k in range(simhash.SEEDS)] + [majority(shingles(5))]


def near_groups(texts):
    """Least id of each group of near copies, by comparing all pairs of sketches."""
    ids, values = [i for i, _ in texts], np.array([brute_sketch(t) for _, t in texts], np.uint64)
    apart = lambda i: np.bitwise_count(values ^ values[i])
    return grouped_by(ids, lambda i: np.flatnonzero((apart(i)[:, :-1].min(axis=1) <= 4) & (apart(i)[:, -1] <= 14)))


def components_of(fps):
    """Least id reachable over links of at most 4 bits, by comparing all pairs."""
    ids, values = [i for i, _ in fps], np.array([f for _, f in fps], np.uint64)
    return grouped_by(ids, lambda i: np.flatnonzero(np.bitwise_count(values ^ values[i]) <= 4))


def grouped_by(ids, near):
    root = list(range(len(ids)))

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for i in range(len(ids)):
        for j in near(i):
            root[find(i)] = find(int(j))
    least = {}
    for i, x in enumerate(ids):
        least[find(i)] = min(least.get(find(i), x), x)
    return {(x, least[find(i)]) for i, x in enumerate(ids)}


def test_simhash_against_brute_force(spark, sf, odd):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").unionByName(odd.filter("doc_id IS NOT NULL").select((F.col("doc_id") + 1000).alias("doc_id"), "text"))
    rows = simhash.near_duplicates(docs).collect()
    text = [(r.doc_id, r.text) for r in docs.collect()]
    fps = [(i, brute_fingerprint(t)) for i, t in text]
    assert sorted((r.doc_id, r.fp % (1 << 64)) for r in rows) == sorted(fps)
    assert {(r.doc_id, r.component) for r in rows} == components_of(fps)


@pytest.mark.parametrize("block", [4, 1024])
def test_links_in_a_dense_cluster(spark, block):
    rng = np.random.default_rng(7)
    base = rng.integers(0, 1 << 63, 3, dtype=np.uint64)
    values = {int(b) for b in base}
    for b in base:
        for _ in range(60):
            v = int(b)
            for bit in rng.choice(64, rng.integers(1, 7), replace=False):
                v ^= 1 << int(bit)
            values.add(v)
    fps = sorted(v - (1 << 64) if v >> 63 else v for v in values)
    roots = {r.node: r.root for r in simhash.components(simhash.links(spark.createDataFrame([(f, [f]) for f in fps], "node long, fp array<long>"), block=block)).collect()}
    want = components_of([(f, f % (1 << 64)) for f in fps])
    assert {(f, roots.get(f, f)) for f in fps} == want


def test_masks_cover_every_small_difference():
    covering = [int(m) for m in simhash.masks(4)]
    rng = np.random.default_rng(9)
    assert len(covering) == 31
    for _ in range(3_000):
        difference = sum(1 << int(b) for b in rng.choice(64, 4, replace=False))
        assert any(not difference & m for m in covering)


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(300)] + [(1000, 1001), (1001, 1000)], "a long, b long")
    roots = {r.node: r.root for r in simhash.components(edges).collect()}
    assert all(roots[i] == 0 for i in range(1, 301)) and roots[1001] == 1000
    assert simhash.components(edges.limit(0)).count() == 0


def test_pipeline_stages_against_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    good = stages["quality rules"](spark, docs, sf)
    assert good.columns == docs.columns
    verdicts = {r.doc_id: r.kept for r in queries.op4_quality(spark, sf).collect()}
    assert {r.doc_id for r in good.collect()} == {i for i, k in verdicts.items() if k}
    unique = stages["simhash near-dedup"](spark, good, sf)
    groups = near_groups([(r.doc_id, r.text) for r in good.collect()])
    assert sorted(r.doc_id for r in unique.collect()) == sorted({c for _, c in groups}) and len(groups) > len({c for _, c in groups})
    private = {r.doc_id: r.text for r in stages["pii"](spark, unique, sf).collect()}
    for r in unique.collect():
        assert (private[r.doc_id] == r.text) == (not brute_pii(r.text)) and not brute_pii(private[r.doc_id])
    mixed = stages["mixing sources to target weights"](spark, unique, sf)
    taken = {r.key: r.taken / r.size for r in mixing.mix(unique).collect()}
    times = {r.doc_id: r["count"] for r in mixed.groupBy("doc_id").count().collect()}
    assert all(abs(times.get(i, 0) - x) <= 0.5 for i, x in taken.items()) and mixed.columns == docs.columns


def test_near_dedup_catches_copies_with_edits(spark):
    rng = np.random.default_rng(12)
    words = np.array([f"w{x}" for x in range(5_000)])
    rows = []
    for i in range(150):
        text = rng.choice(words, 400)
        rows.append((2 * i, " ".join(text)))
        text[rng.choice(400, 6, replace=False)] = "edit"  # six of 400 words: shingles of a similarity of about 0.86
        rows.append((2 * i + 1, " ".join(text)))
    kept = {r.doc_id for r in simhash.one_of_each(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert {i for i, _ in rows if i % 2 == 0} <= kept and sum(i % 2 for i in kept) < 15


def test_simhash_names_a_null_id_only_where_no_other_is(spark, odd, nothing):
    rows = {(r.doc_id, r.component) for r in simhash.near_duplicates(odd).collect()}
    assert {(1, 1), (2, 1), (3, 1), (5, 5), (6, 5)} <= rows
    assert simhash.near_duplicates(nothing).count() == 0 and simhash.one_of_each(nothing).count() == 0
    null = spark.createDataFrame([(None, "a b c d e"), (3, "a b c d e"), (None, "only here")], "doc_id long, text string")
    assert sorted(map(repr, ((r.doc_id, r.component) for r in simhash.near_duplicates(null).collect()))) == sorted(map(repr, [(None, 3), (3, 3), (None, None)]))


def test_near_dedup_keeps_groups_that_share_or_lack_an_id(spark):
    rng = np.random.default_rng(11)
    a, b, c, d, e = (" ".join(f"w{x}" for x in rng.integers(0, 10_000, 60)) for _ in range(5))
    rows = [(None, a, "x"), (None, b, "x"), (None, b, "y"), (None, c, "x"), (4, c, "x"), (7, d, "x"), (7, e, "x"), (8, d, "x"), (7, e, "x"), (9, None, "w"), (9, "w", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    kept = [(r.doc_id, r.text) for r in corpus_pipeline.near_duplicates(spark, docs, "").collect()]
    assert sorted(kept, key=repr) == sorted([(None, a), (None, b), (4, c), (7, d), (7, e), (9, None), (9, "w")], key=repr)


def test_pipeline_of_odd_and_empty_tables(spark, odd, nothing, labels, tmp_path):
    folder = str(tmp_path)
    labels.write.parquet(f"{folder}/labels.parquet")
    for rows in (odd, nothing):
        docs = rows
        for _, stage in corpus_pipeline.STAGES[:-1]:
            docs = stage(spark, docs, folder)
            assert docs.columns == rows.columns
            docs.count()
    # Names of the last stage's and of inner columns: kept, never replaced.
    names = ["ids", "decoded", "n_tokens", "ids_sha256", "decoded_sha256", "verdict", "spans", "pieces", "_verdict", "_spans", "_pieces"]
    own = odd.withColumns({c: F.concat(F.lit(c), F.coalesce(F.col("doc_id").cast("string"), F.lit("-"))) for c in names})
    own.write.parquet(f"{folder}/documents.parquet")
    out = corpus_pipeline.run(spark, folder)
    added = ["_ids", "_decoded", "_n_tokens", "_ids_sha256", "_decoded_sha256"]
    found = out.collect()
    assert out.columns == [*own.columns, *added] and found
    assert all(r[c] == f"{c}{'-' if r.doc_id is None else r.doc_id}" for r in found for c in names)
    assert all(r._n_tokens == len(r._ids) and r._decoded == (r.text or "") for r in found)


def test_near_dedup_recall_from_a_similarity_of_four_fifths(spark):
    rng = np.random.default_rng(14)
    words = np.array([f"w{x}" for x in range(5_000)])
    rows, similar = [], []
    shingles = lambda t: {tuple(t[i : i + 5]) for i in range(len(t) - 4)}
    for i in range(400):
        text = rng.choice(words, 400)
        rows.append((2 * i, " ".join(text)))
        other = text.copy()
        other[rng.choice(400, 8, replace=False)] = [f"edit{i}x{k}" for k in range(8)]
        a, b = shingles(list(text)), shingles(list(other))
        similar.append(len(a & b) / len(a | b))
        rows.append((2 * i + 1, " ".join(other)))
    kept = {r.doc_id for r in simhash.one_of_each(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    close = [i for i, x in enumerate(similar) if 0.8 <= x <= 0.85]
    assert len(close) > 100 and {2 * i for i in range(400)} <= kept
    assert sum(2 * i + 1 not in kept for i in close) >= 0.9 * len(close)


def test_links_of_a_dense_cluster_grow_as_its_size(spark):
    """A group of near copies that lies in many blocks and tables gives few links for each fingerprint, and is connected."""
    rng = np.random.default_rng(15)
    base, values = int(rng.integers(0, 1 << 62)), set()
    while len(values) < 600:
        values.add(base ^ sum(1 << int(i) for i in rng.choice(63, 2, replace=False)))
    nodes = spark.createDataFrame([(i, [v]) for i, v in enumerate(sorted(values))], "node long, fp array<long>")
    for block in (128, 1024):
        edges = simhash.links(nodes, 4, block)
        assert edges.count() < 4 * len(values)
        roots = {r.node: r.root for r in simhash.components(edges).collect()}
        assert set(roots.values()) == {0} and len(roots) + 1 >= len(values)


@pytest.mark.parametrize("block", [16, 1024])
def test_links_are_found_in_few_passes(spark, monkeypatch, block):
    """Groups of one block need no components on the way, and larger ones once; keys are dealt once."""
    rng, written, save = np.random.default_rng(21), [], simhash.saved
    monkeypatch.setattr(simhash, "saved", lambda df, name: written.append(name) or save(df, name))
    values = {(1 << 40) ^ sum(1 << int(i) for i in rng.choice(63, 2, replace=False)) for _ in range(200)}
    edges = simhash.links(spark.createDataFrame([(i, [v]) for i, v in enumerate(sorted(values))], "node long, fp array<long>"), 4, block)
    assert written.count("members") == 1 and written.count("links") == 1 and written.count("known") == (block == 16)
    assert block == 16 or len(written) == 2
    assert {r.root for r in simhash.components(edges).collect()} == {0}
