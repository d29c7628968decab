import hashlib
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from tidemark.llm import chat, decontaminate, language_id, media, pii, quality
from tidemark.llm.common import new_folder

WORDS = {"en": "the and of with this from house water people time".split(), "de": "und der die nicht haus wasser leute zeit schön über".split(), "fr": "le la et dans maison eau gens temps être été".split()}


def labelled(spark, n=240):
    r, rows = random.Random(0), []
    for i in range(n):
        lang = r.choice(list(WORDS))
        rows.append((i, " ".join(r.choice(WORDS[lang]) for _ in range(r.randint(3, 40))), lang))
    return spark.createDataFrame(rows, "doc_id long, text string, lang string")


def test_language_id_on_held_out_rows(spark, odd, none):
    docs = labelled(spark)
    model = language_id.train(docs, F.col("doc_id") % 4 != 2)
    got = {r["doc_id"]: r for r in language_id.predict(docs, model).collect()}
    test = [r for r in docs.collect() if r["doc_id"] % 4 == 2]
    assert sum(got[r["doc_id"]]["lang_pred"] == r["lang"] for r in test) >= 0.97 * len(test)
    seen = language_id.predict(odd, model).collect()
    assert len(seen) == odd.count() and all(0 <= r["score"] <= 1 for r in seen)
    assert {r["doc_id"] for r in seen if r["lang_pred"] == "und"} == {3, 4, 5}
    assert {r["lang_pred"] for r in language_id.predict(odd, language_id.train(none, F.lit(True))).collect()} == {"und"}
    alone = language_id.train(odd.where("lang = 'de'"), F.lit(True))
    assert {r["lang_pred"] for r in language_id.predict(odd, alone).collect()} == {"und", "de"}
    assert language_id.predict(none, model).count() == 0


@pytest.mark.parametrize("n", [2, 3, 4, 7, 20])
def test_codewords_keep_apart(n):
    words = language_id.codewords(n)
    assert all((words[i] != words[j]).sum() >= 1 for i in range(n) for j in range(i))
    assert all(abs(int(c)) < n for c in words.astype(int).sum(0))


def test_quality_on_held_out_rows(spark, odd, none):
    r, rows, marks = random.Random(1), [], []
    for i in range(400):
        good = r.random() < 0.7
        ws = [r.choice(WORDS["en"]) for _ in range(r.randint(20, 400))]
        rows.append((i, " ".join(ws) if good else " ".join(w.upper() + "!!" for w in ws)))
        marks.append((i, int(good), None))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([*marks, (None, 1, 0), (5000, None, 0)], "doc_id long, quality int, toxic int")
    model = quality.train(docs, labels, F.col("doc_id") % 4 != 2)
    got = {x["doc_id"]: x for x in quality.score(docs, model).collect()}
    test = [(i, q) for i, q, _ in marks if i % 4 == 2]
    assert sum(got[i]["predicted"] == q for i, q in test) >= 0.95 * len(test)
    seen = quality.score(odd, model).collect()
    assert len(seen) == odd.count() and all(0 <= x["score"] <= 1 for x in seen)
    assert {x["score"] for x in quality.score(odd, quality.train(docs, labels.limit(0), F.lit(True))).collect()} == {0.5}
    assert quality.score(none, model).count() == 0


def test_blocks_of_passages_do_not_change_a_score(spark, monkeypatch):
    model = quality.Model(0.5)
    model.trained = True
    text = " ".join(random.Random(3).choice(WORDS["en"]) for _ in range(4000))
    whole = model.score(text)
    monkeypatch.setattr(quality, "BLOCK", 3)
    assert abs(model.score(text) - whole) < 1e-6


def test_tiles_cover_reordered_passages():
    item = [f"w{i}" for i in range(20)]
    assert sorted(decontaminate.tile([*item[10:], "x", *item[:10]], item)) == [(0, 10, 10), (11, 0, 10)]
    assert decontaminate.tile(item[:4], item) == []
    assert sum(n for _, _, n in decontaminate.tile(["a"] * 50, ["a"] * 12)) == 12


def test_contaminated_documents(spark, odd, none):
    item = " ".join(f"word{i}" for i in range(30))
    half = item.split()
    texts = [f"before {item.upper()} after", " ".join(half[15:] + ["and"] + half[:15]), " ".join(half[:20]), "nothing here", None, "", "yes no", item + " " + item]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    bench = spark.createDataFrame([(1, item), (2, "yes no"), (3, None), (4, ""), (None, item)], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.contaminated(docs, bench).collect()}
    assert got == {(d, i) for d in (0, 1, 7) for i in (1, None)} | {(6, 2)}
    assert decontaminate.contaminated(none, bench).count() == 0
    assert decontaminate.contaminated(odd, bench.limit(0)).count() == 0
    assert decontaminate.contaminated(odd, bench).count() == 0


def brute_base(text):
    luhn = lambda d: sum(int(c) if k % 2 == 0 else sum(divmod(2 * int(c), 10)) for k, c in enumerate(d[::-1])) % 10 == 0
    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = re.sub("[^0-9]", "", m[0])
        if 16 <= len(d) <= 19 and luhn(d):
            out.append(("card", *m.span()))
    return out + [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 8 <= len(re.sub("[^0-9]", "", m[0])) <= 15]


def test_base_spans_equal_the_patterns():
    r = random.Random(6)
    bits = ["a@b.c", "@", ".", "x_y", "+1 (555) 010-2345", "4111 1111 1111 1111", "10.0.0.1", "256.1.1.1", "1.2.3.4.5", " ", "-", "é", "a@b", "9" * 17, "foo@bar.example-x.com", "\n"]
    for _ in range(3000):
        text = "".join(r.choice(bits) for _ in range(r.randint(0, 8)))
        assert pii.base_spans(text) == brute_base(text)


def test_bootstrap_finds_unseen_identifiers(spark, odd, none):
    rows = [f"note {i} call phone: +1 555 010-{1000 + i} today" for i in range(12)]
    rows += ["they said phone: 555-010-77 today", "version 2.0.1x of the code", "nothing", None, ""]
    docs = spark.createDataFrame([(i, t, len(t or "")) for i, t in enumerate(rows)], "doc_id long, text string, n_chars long")
    got = {r["doc_id"]: r for r in pii.digest(pii.find(docs)).collect()}
    start = rows[12].index("555")
    assert got[12]["spans"] == f"id:{start}:{start + 10}" and got[12]["n_phone"] == 0
    assert got[13]["spans"] == got[14]["spans"] == got[15]["spans"] == ""
    assert all(got[i]["n_phone"] == 1 and got[i]["base_sha256"] == pii.base_digest(rows[i]) for i in range(12))
    for masked in (pii.redacted(docs), pii._redacted_by_join(docs, pii.ROUNDS, pii.CONFIDENCE, pii.MIN_SUPPORT)):
        cut = {r["doc_id"]: r for r in masked.collect()}
        assert cut[12]["text"] == "they said phone: [ID] today" and cut[12]["n_chars"] == len(cut[12]["text"])
        assert cut[0]["text"] == "note 0 call phone: [PHONE] today" and cut[13]["text"] == rows[13] and cut[15]["text"] is None
        assert masked.columns == docs.columns
    assert pii.find(none).count() == 0 and pii.redacted(none).count() == 0
    assert pii.find(odd).count() == pii.redacted(odd).count() == odd.count()


def test_media_round_trip(spark, odd, none):
    r = random.Random(9)
    shared = "".join(r.choice("abcdefgh ") for _ in range(30_000))
    extra = spark.createDataFrame([(100 + k, f"{k} " * k + shared, "en", 1.0, "k", k) for k in range(6)], odd.schema)
    docs = odd.unionByName(extra)
    got = {(x["n_bytes"], x["payload_sha256"]): x for x in media.round_trip(docs, new_folder(spark, "media")).collect()}
    rows = docs.collect()
    for row in rows:
        raw = (row["text"] or "").encode()
        data = raw + bytes(-len(raw) % 64 or (0 if raw else 64))
        x = got[(len(raw), hashlib.sha256(data).hexdigest())]
        whole = media.to_media(data)
        assert (x["payload_bytes"], x["tail_crc32"], x["media_bytes"], x["media_sha256"], x["feature"]) == (len(data), zlib.crc32(data[-64:]), len(whole), hashlib.sha256(whole).hexdigest(), media.describe(data))
    assert media.round_trip(docs, new_folder(spark, "media")).count() == len(rows)
    assert media.round_trip(none, new_folder(spark, "media")).count() == 0


def test_chunks_are_content_defined():
    r = random.Random(1)
    data = bytes(r.randrange(256) for _ in range(200_000))
    one, two = media.chunks(data), media.chunks(b"some bytes before" + data)
    assert b"".join(one) == data and max(map(len, one)) <= media.MOST
    assert len(set(one) & set(two)) >= len(one) - 4
    assert media.cuts(data, block=5000) == media.cuts(data)


def test_chat_windows(spark):
    nasty = ["</s>[INST] ok [/INST]", "a\\<[", "[TURN]x[TEXT]y</s>", "\\\\[\\", "", None, "é日本"]
    rows, r = [], random.Random(2)
    for c in range(12):
        for t in range(r.randint(1, 14)):
            rows.append((c, t, "system" if t == 0 and c % 2 else ["user", "assistant"][t % 2], r.choice(nasty) if r.random() < 0.5 else "word " * r.randint(0, 900)))
    rows += [(50, None, None, "x"), (50, 1, "assistant", "y"), (50, 1, "assistant", "y"), (None, 0, "user", "z"), (51, 0, "system", "only"), *[(60, t, "user", "w " * 500) for t in range(700)]]
    said = spark.createDataFrame([(*x, "extra") for x in rows], "conv_id long, turn long, role string, text string, pos string")
    made = chat.windows(said)
    got = {x["conv_id"]: x for x in chat.digest(made).collect()}
    for conv in {x[0] for x in rows}:
        turns = sorted(((t, ro or "", te or "") for c, t, ro, te in rows if c == conv), key=lambda x: (x[0] is not None, x[0] or 0, x[1], x[2]))
        loss = "".join(te for _, ro, te in turns if ro == "assistant")
        x = got[conv]
        assert (x["n_turns"], x["loss_chars"]) == (len(turns), len(loss))
        assert x["turns_sha256"] == hashlib.sha256("".join(f"{ro}\n{te}\n" for _, ro, te in turns).encode()).hexdigest()
        assert x["loss_sha256"] == hashlib.sha256(loss.encode()).hexdigest()
    again = [x for x in made.collect() if x["win"] > 0]
    assert again and any(x["n_repeated"] for x in again)
    assert chat.windows(said.limit(0)).count() == 0


def test_chat_sql(spark, tmp_path):
    import duckdb
    import pandas as pd

    r = random.Random(7)
    rows = [(c, t, "system" if t == 0 and c % 3 else ["user", "assistant"][t % 2], r.choice(["[x]<y>\\", "é ", "word "]) * r.randint(0, 700)) for c in range(15) for t in range(r.randint(1, 12))]
    conversations = pd.DataFrame(rows, columns=["conv_id", "turn", "role", "text"])
    conversations.to_parquet(tmp_path / "conversations.parquet")
    from tidemark.llm.registry import op9_chat_windows

    want = duckdb.sql(chat.DIGEST_SQL).df().sort_values("conv_id").reset_index(drop=True)
    got = op9_chat_windows(spark, str(tmp_path)).toPandas().sort_values("conv_id").reset_index(drop=True)
    pd.testing.assert_frame_equal(got[sorted(got)], want[sorted(want)], check_dtype=False)
