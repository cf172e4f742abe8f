import hashlib
import zlib

import numpy as np
import pytest
import xxhash

from tabulon.llm import audio, ballhash, chat, langid, packing, pieces, quality, queries, rlindex, urlrules
from tabulon.llm.anchors import anchors
from tabulon.llm.common import Rolling, joined

HARD = [(1, None), (2, ""), (3, " \n\t"), (4, "word"), (5, "ÄÖ ß 日本 🙂"), (6, "word " * 30_000), (7, "same text of a few words here"), (8, "same text of a few words here"), (8, "same text of a few words here"), (None, "no id")]
DOCS = "doc_id long, text string, lang string, source string, k1 string, marks int, row string, score string"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", "clash", 1, "r", "x") for i, t in rows], DOCS)


# --- quality -----------------------------------------------------------------------------------
def test_quality_agrees_with_labels(spark, sf):
    judged = queries.op1_quality(spark, sf).toPandas().set_index("doc_id")
    labels = spark.read.parquet(f"{sf}/labels.parquet").toPandas().set_index("doc_id")
    both = judged.join(labels, how="inner")
    assert ((both.quality == 1) == both.keep).mean() > 0.97
    assert both[both.quality == 1].keep.mean() > 0.99
    assert len(judged) == spark.read.parquet(f"{sf}/documents.parquet").count()


def test_em_finds_accuracies():
    rng = np.random.default_rng(1)
    good = rng.random(20_000) < 0.8
    votes = np.zeros((len(good), 4), np.int8)
    for j, right in enumerate((0.95, 0.9, 0.85, 0.8)):
        voted = rng.random(len(good)) < 0.7
        votes[voted, j] = np.where((rng.random(len(good)) < right) == good, 1, -1)[voted]
    patterns, counts = np.unique(votes, axis=0, return_counts=True)
    model = quality.maximise(patterns, counts.astype(float), advantage=1)
    assert abs(model.prior - 0.8) < 0.06
    voted = (votes != 0).any(axis=1)
    assert ((model.posterior(votes) > 0.5) == good)[voted].mean() > 0.9


def plain_votes(text):
    """The labellers' votes, one text at a time."""
    raw = (text or "").encode()
    words = raw.split()
    if not words:
        return "0" * len(quality.NAMES)
    letter = lambda b: 65 <= b <= 90 or 97 <= b <= 122 or b >= 128
    n, visible = len(words), sum(map(len, words))
    share = lambda test: sum(map(test, raw)) / n
    ascii_letters = sum(letter(b) and b < 128 for b in raw)
    upper = sum(65 <= b <= 90 for b in raw) / max(1, ascii_letters)
    letters, repeats = sum(map(letter, raw)) / visible, sum(a == b for a, b in zip(words, words[1:])) / n
    short = sum(len(w) <= 3 and letter(w[0]) for w in words) / n
    bad = [share(lambda b: chr(b) in "#$%&*+<=>@[]^_`{}~\\") > 0.5, upper > 0.5, sum(raw[i : i + 2] == b"!!" for i in range(len(raw))) / n > 0.1, share(lambda b: b == 124) > 0.15, repeats > 0.2, letters < 0.5, not 2 <= visible / n <= 20, False]
    good = [False] * 5 + [letters > 0.7, 3 < visible / n < 12, short > 0.1 and repeats < 0.1 and n >= 8]
    return "".join("-" if b and n >= 8 else "+" if g else "0" for b, g in zip(bad, good, strict=True))


def plain_score(scorer, text):
    """The scorer's chance, n-gram by n-gram."""
    raw = (text or "").encode()
    words = raw.split()
    if not words:
        return 0.0
    shape = [65 if 65 <= b <= 90 else 97 if 97 <= b <= 122 or b >= 128 else 48 if 48 <= b <= 57 else 32 if 9 <= b <= 13 else b for b in raw + b" "]
    weights = [scorer.weights[0]] * 8 * sum(a == b for a, b in zip(words, words[1:]))
    for n in (2, 4):
        for i in range(len(shape) - n + 1):
            value = n
            for x in shape[i : i + n]:
                value = (value * 131 + x) % 2**32
            weights.append(scorer.weights[(value * 0x9E3779B1 % 2**32) >> 18])
    z = float(np.sum(np.array(weights, float))) / max(1, len(weights)) + scorer.bias
    return 1 / (1 + np.exp(-z))


def test_quality_brute_force(spark, sf):
    """The query's rows worked out one text at a time: votes, posterior by Bayes' rule, score, verdict."""
    table = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    model = quality.learn(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text"))
    got = {r["doc_id"]: r for r in queries.op1_quality(spark, sf).collect()}
    assert set(got) == {r["doc_id"] for r in table}
    for doc, text in table:
        r, votes = got[doc], plain_votes(text)
        assert r["votes"] == votes
        up, down = model.labels.prior, 1 - model.labels.prior
        for j, v in enumerate(votes):
            if v != "0":
                up, down = up * model.labels.good[j, "+0-".index(v)], down * model.labels.bad[j, "+0-".index(v)]
        posterior = up / (up + down) if (text or "").split() else 0.0
        assert abs(r["posterior"] - posterior) < 1e-9 and abs(r["score"] - plain_score(model.scorer, text)) < 1e-5
        if abs((posterior + r["score"]) / 2 - 0.5) > 1e-4:
            assert r["keep"] == ((posterior + r["score"]) / 2 > 0.5)


def test_scores_do_not_depend_on_neighbours(spark, sf):
    model = quality.learn(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text"))
    raw = [b"One text, and its end", b"another!!", b"x | y", b"One text, and its end"]
    together = [np.asarray(x) for x in quality.scores(model, raw)[1:]]
    for i, r in enumerate(raw):
        assert all(np.allclose(t[i], np.asarray(x)[0], atol=1e-12) for t, x in zip(together, quality.scores(model, [r])[1:], strict=True))


def test_quality_hard_rows(spark):
    rows = docs(spark, HARD)
    out = quality.judge(rows, quality.learn(rows)).collect()
    assert len(out) == len(HARD)
    assert not any(r["keep"] for r in out if r["doc_id"] in (1, 2, 3))
    assert quality.judge(rows.limit(0), quality.learn(rows.limit(0))).count() == 0
    assert quality.filtered(rows, quality.learn(rows)).columns == rows.columns


# --- language ----------------------------------------------------------------------------------
def test_language_held_out(spark):
    out = queries.op2_langid(spark, "/root/testdata/sf0.01").toPandas()
    truth = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang").toPandas()
    both = out.merge(truth, on="doc_id")
    assert (both[both.held_out].lang_pred == both[both.held_out].lang).mean() > 0.97
    assert both.score.between(0, 1).all()
    assert all((zlib.crc32(str(d).encode()) % 4 == 2) == h for d, h in zip(both.doc_id, both.held_out, strict=True))


def test_language_hard_rows(spark):
    rows = docs(spark, HARD)
    out = {(r["doc_id"], r["lang_pred"]) for r in langid.identify(rows, langid.learn(rows, ~langid.held_out())).collect()}
    assert {(1, "und"), (2, "und"), (3, "und"), (4, "en"), (5, "en")} <= out
    none = langid.learn(rows.limit(0), ~langid.held_out())
    assert {r["lang_pred"] for r in langid.identify(rows, none).collect()} == {"und"}
    assert langid.identify(rows.limit(0), none).count() == 0


def test_language_rejection(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = langid.learn(docs, ~langid.held_out())
    rows = docs.filter(langid.held_out()).select("text", "lang").collect()
    best, score = langid.predict(model, [r["text"] for r in rows])
    right = np.array([b == r["lang"] for b, r in zip(best, rows, strict=True)])
    assert (score[right] >= model.threshold).mean() > 0.99
    assert 0.0005 * 2 < model.temperature < 10  # not at an end of the grid
    foreign = ["日本語のテキストです。これは言語の判定を試すための文章です。", "Это русский текст для проверки отказа от ответа", "xkcd qwrtp zxcvb mnbvc lkjhg fdspw qzxwv pqxz", "Ελληνικό κείμενο για έλεγχο"]
    assert (langid.predict(model, foreign)[1] < model.threshold).all()
    shuffled = [langid.no_language(r["text"], s) for s, r in enumerate(rows) if len(r["text"]) > 400]
    assert (langid.predict(model, shuffled)[1] < model.threshold).mean() > 0.95
    kept = langid.filtered(spark.createDataFrame([(i, t) for i, t in enumerate([rows[0]["text"], *foreign])], "doc_id long, text string"), model)
    assert [r["doc_id"] for r in kept.collect()] == [0]


def test_language_brute_force(spark, sf):
    """The query's rows worked out subword by subword."""
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "lang")
    model = langid.learn(docs, ~langid.held_out())
    got = {r["doc_id"]: r for r in queries.op2_langid(spark, sf).collect()}
    for doc, text, _ in docs.collect():
        data = langid.plain(np.frombuffer(b" " + text.encode() + b" ", np.uint8)).tobytes()
        logits = []
        for n in langid.SIZES:
            for i in range(len(data) - n + 1):
                gram = data[i : i + n]
                if 32 in gram[1:-1] or gram[0] == gram[-1] == 32:
                    continue
                value = n
                for b in gram:
                    value = (value * 257 + b) % 2**32
                logits.append((value * 0x9E3779B1 % 2**32) >> 17)
        p = langid.softmax((model.logits[logits].astype(float).sum(axis=0) / max(1, len(logits)) + model.bias) / model.temperature)[:-1]
        assert got[doc]["lang_pred"] == model.languages[int(p.argmax())] and abs(got[doc]["score"] - p.max()) < 1e-3
        if abs(p.max() - model.threshold) > 1e-3:
            assert got[doc]["accepted"] == (p.max() >= model.threshold)


def test_no_subword_is_lost_between_blocks(monkeypatch):
    raw = "wörter über die Grenze hinweg, every gram once".encode() * 3
    whole = langid.counts(raw)
    monkeypatch.setattr(langid, "CHUNK", 7)
    for a, b in zip(whole, langid.counts(raw), strict=True):
        assert (a == b).all()


# --- url rules ---------------------------------------------------------------------------------
def test_url_rules(spark):
    urls = [None, "", "nothing", "HTTP://A.Example.NET/en/x", "http://example.net/EN/", "http://x.net", "http://x.net/", "http://xnet/", "http://a.example.com/de/1?q", "http://b.org/fr/", "http://b.org/frx", "http://www.cheap-pills.example.com/en/4", "http://spam-farm.example.org/en/about", "http://spam-farm.example.org/en/aboutx", "http://q.org/a/casino/b", "http://net.org/x", "a://b\n.net/c#d", "x://y?://z.net/"]
    rows = spark.createDataFrame([(i, u, "h", "v") for i, u in enumerate(urls)], "page_id long, url string, host string, verdict string")
    out = {r["page_id"]: (r["host_rule"], r["verdict"]) for r in urlrules.judge(rows).collect()}
    assert out == {0: (None, "allow"), 1: (None, "allow"), 2: (None, "allow"), 3: ("example.net/en/", "allow"), 4: ("net/", "block"), 5: (None, "allow"), 6: ("net/", "block"), 7: (None, "allow"), 8: ("example.com/de/", "block"), 9: ("org/fr/", "allow"), 10: (None, "allow"), 11: (None, "block"), 12: (None, "allow"), 13: (None, "block"), 14: (None, "block"), 15: (None, "allow"), 16: ("net/", "block"), 17: (None, "allow")}
    assert urlrules.judge(rows.limit(0)).count() == 0
    index, loose = urlrules.index_of(urlrules.rules_of(), {"net": 5, "example": 9, "com": 9, "de": 1, "en": 2, "org": 3, "fr": 1, "spam": 0, "farm": 0, "cheap": 0, "pills": 0, "wp": 0, "login": 0, "casino": 0, "about": 0})
    assert {e[0] for b in index for e in b} >= {"net", "de", "fr", "en", "casino"} and not loose


def test_many_rules_are_a_table(spark, monkeypatch):
    urls = ["http://a.example.net/en/x", "http://x.net/", "http://h17.test/p/3", "http://sub.h17.test/p/", "http://h17.test/q", "http://www.cheap-pills.example.com/en/4", None, "nothing", "http://h17.test/p/3"]
    rows = spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "page_id long, url string")
    hosts = (*urlrules.HOST_RULES, *((f"h{i}.test/p/", "block" if i % 2 else "allow") for i in range(2500)))
    patterns = (*urlrules.PATTERN_RULES, "*")
    got = {r["page_id"]: (r["host_rule"], r["verdict"]) for r in urlrules.judge(rows, "url", hosts, patterns).collect()}
    assert got[0] == ("example.net/en/", "allow") and got[2] == got[3] == got[8] == ("h17.test/p/", "block") and got[4] == (None, "block") and len(got) == len(urls)
    few = (*urlrules.HOST_RULES, ("h17.test/p/", "block"))
    want = {r["page_id"]: tuple(r) for r in urlrules.judge(rows, "url", few, patterns).collect()}
    monkeypatch.setattr(urlrules, "MOST_RULES", 1)
    assert {r["page_id"]: tuple(r) for r in urlrules.judge(rows, "url", few, patterns).collect()} == want


# --- packing -----------------------------------------------------------------------------------
def check_packing(rows, texts):
    tokenizer = packing.WordTokens(packing.tokenizer_path()).tokenizer
    want = sorted((d, [*tokenizer.encode(t or "", add_special_tokens=False).ids, packing.END]) for d, t in texts)
    by_doc: dict = {}
    for r in rows:
        by_doc.setdefault(r["doc_id"], []).append(r)
    for d, ids in want:
        mine = [p for p in by_doc[d] if p["doc_tokens"] == len(ids)]
        copies = sum(1 for x in want if x[0] == d)
        assert sum(p["length"] for p in mine) == copies * len(ids)
        for p in mine:
            assert p["ids_crc32"] == zlib.crc32(np.array(ids[p["start"] : p["start"] + p["length"]], "<u4").tobytes())
    sequences: dict = {}
    for r in rows:
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    padding = 0
    for members in sequences.values():
        at = 0
        for offset, length in sorted(members):
            assert offset == at
            at += length
        assert at <= packing.CAPACITY
        padding += packing.CAPACITY - at if at & (at - 1) else 0
    return padding / max(1, sum(r["length"] for r in rows))


def test_packing(spark, sf):
    table = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    assert check_packing(queries.op4_packing(spark, sf).collect(), [tuple(r) for r in table.collect()]) < 0.01
    rows = docs(spark, [r for r in HARD if r[0]])
    check_packing(packing.pack(rows).collect(), [r for r in HARD if r[0]])
    assert packing.pack(rows.limit(0)).count() == 0


def test_piece_lengths():
    for n in [*range(1, 300), 819, 1024, 3000, 4095, 4096, 4097, 9000]:
        got = packing.pieces(n)
        assert sum(got) == n and max(got) <= packing.CAPACITY


@pytest.mark.parametrize("text", ["It's  DON'T we'll\u00a0x ½ ²", "<|endoftext|> hi", "İ Œ é", "e\u0301", "a\x1cb\x85c", "", "!!??..--", "l'été d'œuf 12345"])
def test_word_tokens_are_the_tokenizers(text):
    words = packing.WordTokens(packing.tokenizer_path())
    assert words.encode([text])[0].tolist() == words.tokenizer.encode(text, add_special_tokens=False).ids


# --- audio -------------------------------------------------------------------------------------
def test_audio(spark):
    out = audio.telephony(docs(spark, HARD)).collect()
    assert len(out) == len(HARD)
    for r in out:
        raw = (dict(HARD)[r["doc_id"]] or "").encode()
        payload = raw + b"\xff" * (-len(raw) % 576 or (0 if raw else 576))
        media = audio.wav(payload)
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]))
        assert (r["media_bytes"], r["media_sha256"]) == (len(media), hashlib.sha256(media).hexdigest())
        assert media[44 + 2 :][: len(payload)] == payload and media[20:22] == b"\x07\0"  # mu-law, one byte a sample
        # the features once more, sample by sample
        mu, al = ([int(audio.TABLES[law][x]) for x in payload] for law in (audio.MULAW, audio.ALAW))
        wide = [mu[0]] * 2 + mu + [mu[-1]] * 2
        soft = [(wide[i] + 4 * wide[i + 1] + 6 * wide[i + 2] + 4 * wide[i + 3] + wide[i + 4] + 8) >> 4 for i in range(len(mu))]
        at = [divmod(4 * k, 3) for k in range((3 * len(mu) + 3) // 4)]
        low = [(soft[i] * (3 - p) + soft[min(i + 1, len(soft) - 1)] * p) // 3 for i, p in at]
        rms = lambda x: int((sum(v * v for v in x) // len(x)) ** 0.5)
        said = dict(x.split("=") for x in r["feature"].split(";"))
        assert (int(said["mu_rms"]), int(said["a_rms"]), int(said["pcm_rms"])) == (rms(mu), rms(al), rms(low))
        assert int(said["mu_zc"]) == sum((x < 0) != (y < 0) for x, y in zip(mu, mu[1:])) and int(said["mu_peak"]) == max(map(abs, mu))
        stored = audio.wav(np.array(low, "<i2").tobytes(), audio.PCM, 6000)
        assert (r["pcm_bytes"], r["pcm_sha256"]) == (len(stored), hashlib.sha256(stored).hexdigest())
    assert len({r["feature"] for r in out if r["doc_id"] in (7, 8)}) == 1
    assert audio.telephony(docs(spark, HARD).limit(0)).count() == 0
    pcm = audio.pcm_column(audio.media_column(docs(spark, HARD[3:6]))).collect()
    assert all(audio.unwav(bytes(r["media"]))[:2] == (audio.PCM, 16000) for r in pcm)
    none = spark.createDataFrame([(1, None)], "doc_id int, media binary")
    assert [tuple(r) for r in audio.pcm_column(none).collect()] == [(1, None)]


def test_g711_and_adpcm():
    mu, a = audio.TABLES[audio.MULAW].astype(int), audio.TABLES[audio.ALAW].astype(int)
    assert (mu[0], mu[127], mu[128], mu[255]) == (-32124, 0, 32124, 0)
    assert (a[0x55], a[0xD5], a[0x2A], a[0xAA]) == (-8, 8, -32256, 32256)
    t = np.arange(505)
    pcm = np.stack([8000 * np.sin(t / 9), 3000 * np.cos(t / 5)]).astype(np.int16)
    back = audio.decode_adpcm(audio.encode_adpcm(pcm, 256))
    assert np.abs(back.astype(int) - pcm).mean() < 300
    one = np.concatenate([audio.decode_adpcm(b[None]) for b in audio.encode_adpcm(pcm, 256)])
    assert (one == back).all()
    assert audio.resample(np.array([0, 100, 200], np.int16), 2, 1).tolist() == [0, 50, 100, 150, 200, 200]


# --- chat --------------------------------------------------------------------------------------
def test_chat_round_trip(spark):
    planted = r"\### Assistant: </turn> ok"
    rows = [(1, 1, "assistant", "<turn x>\\l\n"), (1, 0, "user", None), (1, 2, "assistant", "b"), (2, 0, None, "é<"), (-7, 0, "user", planted), (-7, 1, "assistant", planted), (None, 0, "user", "x"), (3, None, "user", "first"), (3, 5, "assistant", "")]
    table = spark.createDataFrame([(*r, "c") for r in rows], "conv_id long, turn long, role string, text string, loss string")
    out = {r["conv_id"]: r for r in chat.digests(table).collect()}
    assert set(out) == {1, 2, 3, -7, None}
    for conv, r in out.items():
        mine = sorted((x for x in rows if x[0] == conv), key=lambda x: (x[1] is not None, x[1] or 0))
        said = "".join(f"{x[2] or ''}\n{x[3] or ''}\n" for x in mine)
        loss = "".join(x[3] or "" for x in mine if x[2] == "assistant")
        assert r["n_turns"] == len(mine) and r["turns_sha256"] == hashlib.sha256(said.encode()).hexdigest()
        assert r["loss_chars"] == len(loss) and r["loss_sha256"] == hashlib.sha256(loss.encode()).hexdigest()
    text = {r["conv_id"]: r for r in chat.formatted(table).collect()}
    assert all(len(text[c]["text"]) == out[c]["formatted_chars"] for c in out)
    span = text[-7]["loss"][0]
    assert chat.unescape(text[-7]["text"][span["start"] : span["end"]]) == planted
    assert chat.digests(table.limit(0)).count() == 0


def test_template_language():
    render = lambda t, **v: "".join(p for p, _ in chat.compiled(t)(v.pop("messages", []), **v))
    assert render("{% for m in messages %}{{ loop.index }}{{ m.a }}{% if not loop.last %},{% endif %}{% endfor %}", messages=[{"a": "x"}, {"a": "y"}]) == "1x,2y"
    assert render("{% if 1 == 2 %}a{% elif x > 1 and 'b' in 'abc' %}b{% else %}c{% endif %}", x=2) == "b"
    assert render("{{ 'a' ~ 1 }}|{{ x.y.z }}|{{ ('q' | upper) ~ none }}", x={"y": {"z": 3}}) == "a1|3|Q"
    tree = chat.parse("{% set a = 'x' + 'y' %}{{ a | upper }}{% if a == 'xy' %}!{% endif %}")
    assert chat.fold_body(tree, {"": chat.names_bound(tree, {})}) == [("text", "XY!")]
    for bad in ("{{ x.__class__ }}", "{{ ''.join }}"):
        with pytest.raises(chat.TemplateError):
            render(bad, x=object())
    for bad in ("{% for %}", "{% if x %}", "{{ f() }}", "{{ x | system }}", "{% import os %}"):
        with pytest.raises(chat.TemplateError):
            chat.compiled(bad)


# --- near duplicates ---------------------------------------------------------------------------
def brute_fingerprint(text):
    words = (text or "").encode().lower().split()
    shingles = [b" ".join(words[i : i + 4]) for i in range(len(words) - 3)] if len(words) >= 4 else [b" ".join(words)] if words else []
    bits = 0
    for b in range(64):
        if 2 * sum(xxhash.xxh64_intdigest(s, 42) >> b & 1 for s in shingles) > len(shingles):
            bits |= 1 << b
    return bits


def brute_classes(fps):
    label = {d: d for d, _ in fps}

    def root(d):
        while label[d] != d:
            d = label[d]
        return d

    for i, (d, f) in enumerate(fps):
        for e, g in fps[:i]:
            if (f ^ g).bit_count() <= 4:
                a, b = sorted((root(d), root(e)))
                label[b] = a
    return {d: root(d) for d, _ in fps}


def test_near_duplicates_brute_force(spark, sf):
    table = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    fps = [(r["doc_id"], brute_fingerprint(r["text"])) for r in table]
    out = queries.op8_ballhash(spark, sf).collect()
    assert {r["doc_id"]: r["fingerprint"] for r in out} == {d: f"{f:016x}" for d, f in fps}
    assert {r["doc_id"]: r["component_id"] for r in out} == brute_classes(fps)


def test_links_of_crowded_fingerprints(spark, monkeypatch):
    rng = np.random.default_rng(3)
    base = rng.integers(0, 1 << 62, 4, dtype=np.uint64)
    fps = {0, (1 << 64) - 1}
    for _ in range(400):
        f = int(base[rng.integers(4)])
        for b in rng.integers(0, 64, rng.integers(0, 7)):
            f ^= 1 << int(b)
        fps.add(f)
    fps = sorted(fps)
    monkeypatch.setattr(ballhash, "MOST_VARIANTS", 3000)
    table = spark.createDataFrame([(int(np.uint64(f).astype(np.int64)), i) for i, f in enumerate(fps)], "fp long, node long")
    edges = ballhash.links(table, len(fps)).collect()
    numbered = list(enumerate(fps))
    label = list(range(len(fps)))

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    for e in edges:
        a, b = sorted((root(e["u"]), root(e["v"])))
        label[b] = a
    want = brute_classes(numbered)
    assert {i: root(i) for i, _ in numbered} == want
    roots = {r["u"]: r["v"] for r in ballhash.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert {i: roots.get(i, i) for i, _ in numbered} == want


def test_near_duplicate_hard_rows(spark):
    rows = docs(spark, HARD)
    out = ballhash.classes(rows).collect()
    assert len(out) == len(HARD)
    assert {r["fingerprint"] for r in out if r["doc_id"] in (1, 2, 3)} == {"0" * 16}
    assert {r["component_id"] for r in out if r["doc_id"] in (7, 8)} == {7}
    kept = ballhash.representatives(rows)
    assert kept.columns == rows.columns
    ids = [r["doc_id"] for r in kept.collect()]
    assert 7 in ids and 8 not in ids and None in ids and 1 in ids and 2 not in ids
    assert ballhash.classes(rows.limit(0)).count() == 0


def test_representatives_of_repeated_ids(spark):
    rows = [(1, "one text of several words", 0), (1, "Another  text, unlike the first", 1), (1, "another text, unlike the first ", 2), (2, "ONE text of several words", 3), (3, None, 4), (4, "", 5)]
    table = spark.createDataFrame([(*r, "c", "d") for r in rows], "doc_id long, text string, least_id int, id string, row string")
    out = ballhash.representatives(table)
    assert out.columns == table.columns
    kept = sorted((r["doc_id"], r["text"]) for r in out.collect() if r["text"] is not None)
    assert kept[0][0] == 1 and len(kept) == 2 and any("several" in t for _, t in kept) and any("nlike" in t for _, t in kept)
    assert [r["doc_id"] for r in out.collect() if not r["text"]] == [3]


# --- pieces ------------------------------------------------------------------------------------
def test_samples_follow_the_lattice():
    model = pieces.loaded(pieces.model_path(), pieces.TEMPERATURE)
    every = {tuple(ids): np.exp(log) for ids, log, _, _ in pieces.sample(model, "the", 500, 1)}
    assert abs(sum(every.values()) - 1) < 1e-9
    first, second, n = {}, {}, 4000
    for seed in range(n):
        a, b = pieces.sample(model, "the", 2, seed)
        assert a[2] >= b[2] and a[0] != b[0] and 0 < b[3] <= 1
        first[tuple(a[0])] = first.get(tuple(a[0]), 0) + 1 / n
        second[tuple(b[0])] = second.get(tuple(b[0]), 0) + 1 / n
    for ids, p in every.items():
        assert abs(first.get(ids, 0) - p) < 0.03
        assert abs(second.get(ids, 0) - sum(q * p / (1 - q) for o, q in every.items() if o != ids)) < 0.03


def test_pieces_hard_rows(spark):
    texts = [None, "", " ", "▁ mark", "tab\tnew\nline  two", "日本🙂", "x" * 5000, "word " * 4000]
    rows = spark.createDataFrame([(i, 0, "r", t, "c") for i, t in enumerate(texts)] + [(1, 0, "r", "", "c")], "conv_id long, turn long, role string, text string, ids string")
    out = pieces.segment(rows).collect()
    assert all(r["decoded"] for r in out)
    assert sum(r["conv_id"] == 7 for r in out) == 3 and sum(r["conv_id"] == 1 for r in out) == 2
    assert len({tuple(r["ids"]) for r in out if r["conv_id"] == 6}) == 3
    assert pieces.segment(rows.limit(0)).count() == 0


@pytest.mark.parametrize("head", [pieces.HEAD, 1])
def test_tails_are_searched_like_heads(monkeypatch, head):
    """With one place of its own a path's other ways come from its tail: the same segmentations, chances in the same shares."""
    monkeypatch.setattr(pieces, "HEAD", head)
    model = pieces.loaded(pieces.model_path(), pieces.TEMPERATURE)
    every = {tuple(ids): np.exp(log) for ids, log, _, _ in pieces.sample(model, "in the", 500, 1)}
    assert abs(sum(every.values()) - 1) < 1e-9 and len(every) > 10
    n, second = 3000, {}
    for seed in range(n):
        a, b = pieces.sample(model, "in the", 2, seed)
        assert a[2] >= b[2] and a[0] != b[0]
        second[tuple(b[0])] = second.get(tuple(b[0]), 0) + 1 / n
    for ids, p in every.items():
        assert abs(second.get(ids, 0) - sum(q * p / (1 - q) for o, q in every.items() if o != ids)) < 0.035


@pytest.mark.parametrize("before", [0, 44, 45, 46, 47, 95])
def test_samples_of_a_long_run(before):
    model = pieces.loaded(pieces.model_path(), pieces.TEMPERATURE)
    text = "\x01" * before + "the" + "\x01" * 50

    def ways(at):
        if at == len(shown):
            yield (), 0.0
            return
        own = [model.bytes[b] for b in shown[at].replace(pieces.MARK, " ").encode()]
        steps = [(end, (model.ids[shown[at:end]],)) for end in range(at + 1, len(shown) + 1) if shown[at:end] in model.ids]
        if shown[at] not in model.ids:
            steps.append((at + 1, tuple(own)))
        for end, ids in steps:
            for rest, log in ways(end):
                yield ids + rest, log + sum(model.weight[i] for i in ids)

    shown = pieces.MARK + text
    want = dict(ways(0))
    whole = np.log(sum(np.exp(np.array(list(want.values())) - max(want.values())))) + max(want.values())
    got = {tuple(ids): log for ids, log, _, _ in pieces.sample(model, text, 500, 1)}
    assert set(got) == set(want)
    assert all(abs(got[ids] - log + whole) < 1e-9 for ids, log in want.items())


def test_pieces_of_every_document(spark, sf):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    out = queries.op9_pieces(spark, sf).collect()
    assert {r["doc_id"] for r in out} == set(texts)
    model = pieces.loaded(pieces.model_path(), pieces.TEMPERATURE)
    assert all(r["decoded"] and model.decode(r["ids"]) == (texts[r["doc_id"]] or "") for r in out)


def test_samples_do_not_depend_on_the_batch(monkeypatch):
    texts = ["one two three two one", "", "two  words ", "▁ 日本 x", None, "another text of words, two of them rare: qzxv xvqz"] * 4
    seeds = list(range(100, 100 + len(texts)))
    model = pieces.Pieces(pieces.model_path())
    flat = lambda found: [(ids.tolist(), *rest) for ids, *rest in found]
    together = [flat(f) for f in pieces.samples(model, texts, 4, seeds)]
    monkeypatch.setattr(pieces, "MOST_NODES", 30)  # words are forgotten between texts
    alone = [flat(pieces.samples(model, [t], 4, [s])[0]) for t, s in zip(texts, seeds, strict=True)]
    assert alone == together and len(model.first) < 500
    assert together[0] != together[6] and [f[0] for f in together[1]] == [[]]


def test_words_share_the_places_of_their_beginnings():
    texts = ["under undertake undertaker", "undertaker's", "x" * 60 + " " + "x" * 60 + "y"]
    model = pieces.Pieces(pieces.model_path())
    flat = lambda found: [(ids.tolist(), *rest) for ids, *rest in found]
    together = [flat(f) for f in pieces.samples(model, texts, 4, [1, 2, 3])]
    # A start, the longest of the first words, and two long ones that have the first 48 places in common.
    assert len(model.first) == 1 + len(" undertaker's") + 47 + 13 + 14
    assert together == [flat(pieces.samples(pieces.Pieces(pieces.model_path()), [t], 4, [s])[0]) for t, s in zip(texts, [1, 2, 3], strict=True)]


def test_plain_encoding_and_decoding(spark):
    rows = spark.createDataFrame([(1, "a text"), (2, None), (3, ""), (4, "  \n x")], "doc_id long, text string")
    out = pieces.encoded(rows)
    model = pieces.loaded(pieces.model_path(), pieces.TEMPERATURE).model
    got = {r["doc_id"]: r["ids"] for r in out.collect()}
    assert got == {1: model.encode("a text"), 2: None, 3: [], 4: model.encode("  \n x")}
    assert {r["doc_id"]: r["text"] for r in pieces.decoded(out.drop("text")).collect()} == {1: "a text", 2: None, 3: "", 4: "  \n x"}


# --- repeated passages -------------------------------------------------------------------------
def brute_marks(texts, length):
    where: dict = {}
    for i, t in enumerate(texts):
        for s in range(len(t) - length + 1):
            where.setdefault(t[s : s + length], []).append((i, s))
    gone = [np.zeros(len(t), bool) for t in texts]
    for places in where.values():
        if len(places) > 1:
            for i, s in places:
                gone[i][s : s + length] = True
    return gone


def brute_digest(texts, length):
    out = []
    for t, g in zip(texts, brute_marks(texts, length), strict=True):
        starts = int((g & ~np.concatenate([[False], g[:-1]])).sum()) if len(g) else 0
        out.append((len(t), int(g.sum()), starts, hashlib.sha256(bytes(np.frombuffer(t, np.uint8)[~g])).hexdigest()))
    return out


def repetitive(rng, n):
    word = lambda: "".join(rng.choice(list("abcdé"), int(rng.integers(1, 7))))
    prose = lambda k: " ".join(word() for _ in range(k))
    passages = [prose(int(rng.integers(8, 60))) for _ in range(5)]
    texts = []
    for _ in range(n):
        kind = rng.integers(6)
        if kind == 0 and texts:
            texts.append(texts[rng.integers(len(texts))])
        elif kind == 1 and texts:
            old = list(texts[rng.integers(len(texts))])
            for _ in range(3):
                if old:
                    old[int(rng.integers(len(old)))] = "z"
            texts.append("".join(old))
        elif kind == 2:
            texts.append((word() + " ") * int(rng.integers(5, 80)))
        else:
            texts.append(prose(int(rng.integers(0, 40))) + passages[rng.integers(5)] * int(rng.integers(1, 3)) + prose(int(rng.integers(0, 40))))
    return texts


@pytest.mark.parametrize("hot", [rlindex.HOT, 3])
def test_repeats_brute_force(spark, hot):
    texts = repetitive(np.random.default_rng(5 + hot % 7), 120) + ["", "a" * 39, "a" * 40, "b" * 41, "q" * 300]
    rows = docs(spark, list(enumerate(texts)))
    want = brute_digest([t.encode() for t in texts], 40)
    out = rlindex.digests(rows, 40, hot).collect()
    assert {r["doc_id"]: tuple(r)[1:5] for r in out} == dict(enumerate(want))
    for r in out:
        raw, gone = texts[r["doc_id"]].encode(), [(x["start"], x["end"]) for x in r["removed"]]
        assert rlindex.left(raw, gone).decode("utf-8", "ignore") == r["text"] and len(gone) == r["n_spans"]


def test_repeats_production_length(spark, sf):
    table = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    want = brute_digest([r["text"].encode() for r in table], 400)
    got = {r["doc_id"]: tuple(r)[1:5] for r in queries.op10_rlindex(spark, sf).collect()}
    assert got == {r["doc_id"]: w for r, w in zip(table, want, strict=True)}
    assert sum(w[1] for w in want) > 0


def test_repeats_hard_rows(spark):
    rows = docs(spark, HARD)
    out = rlindex.digests(rows).collect()
    assert len(out) == len(HARD)
    gone = {r["doc_id"]: (r["n_bytes"], r["n_removed"]) for r in out}
    assert gone[1] == (0, 0) and gone[6] == (150_000, 150_000) and gone[8][1] == 0
    trimmed = rlindex.trimmed(rows)
    assert trimmed.columns == rows.columns
    text = {r["doc_id"]: r["text"] for r in trimmed.collect()}
    assert text[1] is None and text[6] == "" and text[5] == HARD[4][1]
    assert rlindex.digests(rows.limit(0)).count() == 0


def test_anchors_brute_force():
    rng = np.random.default_rng(0)
    for _ in range(50):
        texts = [bytes(rng.integers(97, 97 + int(rng.integers(1, 4)), int(rng.integers(0, 60))).astype(np.uint8)) for _ in range(5)]
        text, first, last, h = anchors(*joined(texts), 20, 4)
        for i, t in enumerate(texts):
            want: list = []
            grams = Rolling(np.frombuffer(t, np.uint8)).grams(4)
            for s in range(len(t) - 19):
                x = grams[s : s + 17]
                place = s + int(x.argmin())
                if want and want[-1][3] == place:
                    want[-1][1] = s
                else:
                    want.append([s, s, x.min(), place])
            assert [tuple(w[:3]) for w in want] == [(int(a), int(b), c) for q, a, b, c in zip(text, first, last, h, strict=True) if q == i]
