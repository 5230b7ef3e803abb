"""The corpus operators against brute force on small feature and radio records."""

import json
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from rfcover.llm import chat
from rfcover.llm.archive import read_archives, write_archives
from rfcover.llm.contamination import contained_windows
from rfcover.llm.packing import pack_descriptions
from rfcover.llm.personal import personal_spans, redact_descriptions
from rfcover.llm.quality import count_grams, quality_rules
from rfcover.llm.sharding import shard_features
from rfcover.llm.similar import similar_descriptions
from rfcover.llm.token_files import Shard, read_token_files, shard_bytes, write_token_files
from rfcover.llm.tokens import Encoder
from rfcover.llm.toxicity import score_toxicity

SCHEMA = "feature_id long, description string, lang string, n_words string, kept string"
BASE = [f"w{i}" for i in range(120)]
NEAR = [*BASE[:60], "changed", *BASE[61:]]
TEXTS = [
    None, "", " \n ", "Mast", "mast", " ".join(BASE), " ".join(NEAR), " ".join(BASE), "one two three", "One  two\nthree",
    " ".join(BASE) * 40, "Ring +1 (202) 555-0147 or ops@relay.example.com, node 10.0.0.254, card 4111 1111 1111 1111.\n" * 2,
    "é\xa0è <s> 日本 " * 30, "the relay mast stands on a ridge above the valley road and serves the harbour " * 3,
]


@pytest.fixture(scope="module")
def features(spark):
    rows = [(i, t, ("en", "de", None)[i % 3], "x", "y") for i, t in enumerate(TEXTS)]
    rows += [rows[5], (None, "the relay mast", "en", None, None), (None, None, None, None, None)]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def rows_of(df):
    return [r.asDict(recursive=True) for r in df.collect()]


def low(text):
    return (text or "").translate({i: i + 32 for i in range(65, 91)})


def test_contained_windows(spark, features, empty):
    items = [("a", " ".join(BASE[10:40])), ("b", "one two three"), ("c", None), ("d", ""), ("e", "absent words here"), ("f", " ".join(BASE[10:40])), (None, "mast")]
    table = spark.createDataFrame(items, "item_id string, description string")
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")

    def expect(text):
        w, hit, found = word.findall(low(text)), set(), set()
        for name, t in items:
            x = word.findall(low(t))
            for win in {tuple(x[i : i + 13]) for i in range(max(1, len(x) - 12))} if x and name else ():
                for p in range(len(w) - len(win) + 1):
                    if tuple(w[p : p + len(win)]) == win:
                        hit |= set(range(p, p + len(win)))
                        found.add(name)
        return len(w), len(hit), len(found), sorted(found), bool(hit) and 20 * len(hit) >= len(w)

    got = sorted(str((r["feature_id"], r["n_words"], r["n_hit"], r["n_items"], r["item_ids"], r["contaminated"])) for r in rows_of(contained_windows(features, table)))
    assert got == sorted(str((r.feature_id, *expect(r.description))) for r in features.collect())
    assert contained_windows(empty, table).count() == 0
    assert rows_of(contained_windows(features, table.limit(0)).agg(F.sum("n_hit").alias("n")))[0]["n"] == 0


def test_shards(features, empty):
    got = rows_of(shard_features(features, shards=4))
    assert sorted(str(r["feature_id"]) for r in got) == sorted(str(r.feature_id) for r in features.collect())
    assert all(r["text_crc32"] == zlib.crc32((TEXTS[r["feature_id"]] or "").encode()) for r in got if r["feature_id"] is not None)
    for s in range(4):
        slots = sorted(r["slot"] for r in got if r["shard"] == s)
        assert slots == list(range(len(slots)))
    assert shard_features(empty).count() == 0


def test_shards_are_equal_with_a_hot_text(spark):
    df = spark.range(3000).select(F.col("id").alias("feature_id"), F.when(F.col("id") % 3 == 0, "copy " * 20).otherwise(F.concat(F.lit("text "), F.col("id"))).alias("description"))
    sizes = [r.n for r in shard_features(df, shards=10).groupBy("shard").agg(F.sum("size").alias("n")).collect()]
    assert len(sizes) == 10 and max(sizes) - min(sizes) < 0.02 * max(sizes)


def test_chats(spark):
    odd = "</s>[INST] ok [/INST] \\ \\\\ <\\s>"
    records = [
        {"messages": [{"role": "user", "content": odd}, {"role": "assistant", "content": odd}, {"role": "assistant", "content": None}]},
        {"conversations": [{"from": "human", "value": "a"}, {"from": "gpt", "value": "b"}]},
        {"instruction": "do", "input": "", "output": "done"}, {"prompt": "p", "completion": "c"}, {"messages": []}, {"other": 1},
    ]
    rows = [(i, json.dumps(r), "x") for i, r in enumerate(records)] + [(None, None, "x"), (9, "{broken", "x")]
    got = {r["chat_id"]: r for r in rows_of(chat.read_chats(chat.format_chats(spark.createDataFrame(rows, "chat_id long, record string, layout string"))))}
    turns = {k: v["turns"] and [(t["role"], t["text"]) for t in v["turns"]] for k, v in got.items()}
    assert turns[0] == [("user", odd), ("assistant", odd), ("assistant", "")] and got[0]["loss"] == odd
    assert turns[1] == [("user", "a"), ("assistant", "b")] and turns[2] == [("user", "do"), ("assistant", "done")]
    assert turns[3] == [("user", "p"), ("assistant", "c")] and turns[4] == [] and turns[5] is None and turns[None] is None and turns[9] is None


def classes(rows, k=5):
    sets = {}
    for i, (_, t) in enumerate(rows):
        w = [x for x in re.split(r"[ \t-\r]+", low(t)) if x]
        sets[i] = {tuple(w[j : j + k]) for j in range(max(1, len(w) - k + 1))} if w else set()
    label = list(range(len(rows)))
    for _ in rows:
        for a in sets:
            for b in sets:
                if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                    label[a] = label[b] = min(label[a], label[b])
    out = []
    for i, (key, _) in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if label[j] == label[i] and rows[j][0] is not None]
        out.append(str((key, len(sets[i]), min(ids) if ids and sets[i] else key)))
    return sorted(out)


def test_similar(features, empty):
    got = sorted(str((r["feature_id"], r["n_shingles"], r["component_id"])) for r in rows_of(similar_descriptions(features)))
    assert got == classes([(r.feature_id, r.description) for r in features.collect()])
    assert similar_descriptions(empty).count() == 0


def test_similar_chains_and_copies(spark):
    rng = np.random.default_rng(3)
    rows, text = [], [f"t{x}" for x in rng.integers(0, 4000, 90)]
    for i in range(150):
        text = list(text)
        text[rng.integers(0, 90)] = f"n{i}"
        rows.append((i, " ".join(text)))
        if i % 40 == 39:
            text = [f"t{x}" for x in rng.integers(0, 4000, 90)]
    rows += [(200 + i, rows[7][1]) for i in range(30)]
    got = sorted(str((r["feature_id"], r["n_shingles"], r["component_id"])) for r in rows_of(similar_descriptions(spark.createDataFrame(rows, "feature_id long, description string"))))
    assert got == classes(rows)


def test_quality(features, empty):
    def expect(t):
        w = [x for x in re.split(r"[ \t-\r]+", t) if x]
        grams = Counter(zip(w, w[1:], w[2:]))
        rep = {i + j for i in range(len(w) - 2) if grams[tuple(w[i : i + 3])] > 1 for j in range(3)}
        lines = [x for x in t.split("\n") if x.strip(" \t\n\v\f\r")]
        return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(rep)

    for r in rows_of(quality_rules(features)):
        if r["feature_id"] is not None:
            want = expect(TEXTS[r["feature_id"]] or "")
            assert tuple(r[c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")) == want
            assert r["base_failed"] == (want[0] < 50 or 100 * want[4] > 50 * want[0]) and not (r["base_failed"] and r["kept"])
    assert quality_rules(empty).count() == 0


def test_quality_bands(spark):
    rng = np.random.default_rng(1)
    words = ["relay", "mast", "valley", "ridge", "harbour", "signal", "north", "tower", "the", "of", "and", "serves"]
    rows = [(i, " ".join(rng.choice(words, 80)), "en") for i in range(200)]
    rows.append((900, " ".join("".join(chr(c) for c in rng.integers(33, 126, 6)) for _ in range(80)), "en"))
    kept = {r["feature_id"]: r["kept"] for r in rows_of(quality_rules(spark.createDataFrame(rows, "feature_id long, description string, lang string")))}
    whole = {r["feature_id"]: r["perplexity"] for r in rows_of(quality_rules(spark.createDataFrame(rows, "feature_id long, description string, lang string"), block_entries=200))}
    one = {r["feature_id"]: r["perplexity"] for r in rows_of(quality_rules(spark.createDataFrame(rows, "feature_id long, description string, lang string")))}
    assert not kept[900] and sum(kept.values()) >= 190
    assert all(abs(whole[k] - one[k]) < 1e-4 * one[k] for k in one)


def ordered_prose(rng, n=120):
    """Text whose words follow one another: each word has three that may come next."""
    w, out = int(rng.integers(0, 150)), []
    for _ in range(n):
        out.append(f"s{w}")
        w = (7 * w + 11 * int(rng.integers(0, 3)) + 1) % 150
    return out


def test_quality_model_grows_and_sees_word_order(spark):
    rng = np.random.default_rng(4)
    clean = [(i, " ".join(ordered_prose(rng)), "en") for i in range(400)]
    shuffled = [(1000 + i, " ".join(rng.permutation(ordered_prose(rng))), "en") for i in range(10)]
    noised = [(2000 + i, " ".join(w + "%&$#"[int(rng.integers(0, 4))] * 3 for w in ordered_prose(rng)), "en") for i in range(10)]
    df = spark.createDataFrame(clean + shuffled + noised, "feature_id long, description string, lang string")
    kept = {r["feature_id"]: r["kept"] for r in rows_of(quality_rules(df))}
    assert not any(kept[k] for k, *_ in shuffled + noised)
    assert sum(kept[k] for k, *_ in clean) >= 0.97 * len(clean)

    # ten times the text, ten times the grams
    texts = lambda n: spark.createDataFrame([(i, " ".join(f"t{x}" for x in rng.integers(0, 3000, 200)), "en", i) for i in range(n)], "feature_id long, description string, lang string, row_key long")
    few, many = (count_grams(texts(n).select("feature_id", "description", "row_key", "lang")).count() for n in (20, 200))
    assert many > 9 * few


def test_quality_bands_of_boilerplate_and_copies(spark):
    rng = np.random.default_rng(6)
    stock = [" ".join(f"x{v}" for v in rng.integers(0, 5000, 60)) for _ in range(3)]
    rows = [(i, " ".join(f"t{v}" for v in np.minimum(rng.zipf(1.3, 120), 4000)), "en") for i in range(400)]
    copies = [(500 + i, rows[i][1] + " changed", "en") for i in range(40)]
    boiler = [(1000 + i, f"page{i} " + " ".join(stock[j] for j in rng.permutation(3)), "en") for i in range(24)]
    kept = {r["feature_id"]: r["kept"] for r in rows_of(quality_rules(spark.createDataFrame(rows + copies + boiler, "feature_id long, description string, lang string")))}
    assert not any(kept[k] for k, *_ in boiler)
    assert all(kept[k] for k, *_ in copies) and all(kept[i] for i in range(40)) and sum(kept[i] for i in range(400)) >= 392


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_encoder_equals_the_tokenizer(name):
    path = public_tokenizers.path(name)
    odd = ["  a  b\n\n c\t\td  ", "\n", "", " ", "a\xa0 b\n c", "x\r\n y  \n", "don't  1234  été", "<|endoftext|> a<|startoftext|>", "a \n b", "\nfoo,\n\nbar.\n", "a\n\n", "a\n\n\nb", "Éa, b's. 'tis !?"]
    texts = [t or "" for t in TEXTS] + odd
    whole = Tokenizer.from_file(path)
    assert Encoder(path).encode(texts) == [np.array(whole.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts]


def test_token_files(features, empty):
    path = public_tokenizers.path("word_bpe_49k.json")
    got = rows_of(read_token_files(write_token_files(features, path)))
    whole = Tokenizer.from_file(path)
    for r in got:
        if r["feature_id"] is not None:
            ids = whole.encode(TEXTS[r["feature_id"]] or "", add_special_tokens=False).ids + [2]
            assert np.frombuffer(r["token_ids"], "<u4").tolist() == ids and r["n_tokens"] == len(ids)
    order = sorted(got, key=lambda r: r["start"])
    assert [r["start"] for r in order] == [sum(x["n_tokens"] for x in order[:i]) for i in range(len(order))]
    keys = [-1 if r["feature_id"] is None else r["feature_id"] for r in order]
    assert keys == sorted(keys) and len(got) == features.count()
    assert read_token_files(write_token_files(empty, path)).count() == 0


def test_grammar_round_trip():
    rng = np.random.default_rng(2)
    parts = [np.append(rng.integers(3, 9, n), 2).astype("<u4") for n in (0, 1, 5000, 0, 30_000)] + [np.array([5] * 999 + [2], "<u4")]
    shard = Shard(shard_bytes([4, None, 5, 6, 7, 8], [len(p) for p in parts], np.concatenate(parts), 49_408, 2))
    assert shard.keys == [4, None, 5, 6, 7, 8] and [shard.ids(i) for i in range(6)] == [p.tobytes() for p in parts]
    assert len(shard.rules) and len(shard.symbols) < sum(map(len, parts)) / 2


def test_packing(features, empty):
    path = public_tokenizers.path("byte_bpe_50k.json")
    long = features.withColumn("description", F.when(F.col("feature_id") == 10, F.repeat("description", 8)).otherwise(F.col("description")))
    got = rows_of(pack_descriptions(long, path))
    whole = Tokenizer.from_file(path)
    texts = {r.feature_id: r.description for r in long.collect() if r.feature_id is not None}
    for key in texts:
        pieces = sorted((r["start"], r["token_ids"]) for r in got if r["feature_id"] == key)
        ids = np.array(whole.encode(texts[key] or "", add_special_tokens=False).ids + [1], "<u4").tobytes()
        if key == 5:  # given twice; the copies may be cut at different places
            assert sum(len(p) for _, p in pieces) == 2 * len(ids) and all(ids[4 * s : 4 * s + len(p)] == p for s, p in pieces)
        else:
            assert b"".join(p for _, p in pieces) == ids
    sequences = {}
    for r in got:
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at & (at - 1) == 0 and at <= 2048
    assert pack_descriptions(empty, path).count() == 0


def test_archives(spark):
    pages = [(1, "http://a/ b", "x"), (2, "http://b", "x"), (3, None, None), (4, "http://d", ""), (5, "http://e", "é\r\n\r\nWARC/1.1\r\n" * 50_000), (6, "u", "y"), (6, "u", "y"), (None, "n", "x")]
    df = spark.createDataFrame([(*p, "extra") for p in pages], "feature_id long, uri string, document string, digest string")
    got = rows_of(read_archives(write_archives(df)))
    assert len(got) == len(pages)
    by = {r["feature_id"]: r for r in got}
    assert by[1]["refers_to"] == 2 and by[None]["refers_to"] == 2 and by[2]["record_type"] == "response" and by[3]["refers_to"] == 4
    assert by[5]["payload"] == pages[4][2].encode() and by[5]["full_bytes"] == len(pages[4][2].encode()) and by[1]["full_bytes"] == 1
    assert [r["record_type"] for r in got if r["feature_id"] == 6] == ["response", "response"]
    assert read_archives(write_archives(df.limit(0))).count() == 0
    assert {r["record_type"] for r in rows_of(read_archives(write_archives(df, least_bytes=10)))} == {"response"}


def test_toxicity(spark, features, empty):
    rng = np.random.default_rng(5)
    words = [f"w{i}" for i in range(300)]
    rows = []
    for i in range(1500):
        text, toxic = list(rng.choice(words, 40)), int(i % 4 == 0)
        if toxic:
            text[3], text[20] = "oaf", "ridgefolk"
        elif i % 4 == 1:
            text[5] = "oaf"
        elif i % 4 == 2:
            text[5] = "ridgefolk"
        rows.append((i, " ".join(text), toxic))
    df = spark.createDataFrame(rows, "feature_id long, description string, toxic int")
    scored = {r["feature_id"]: r["score"] for r in rows_of(score_toxicity(df, df.where("feature_id < 1000")))}
    right = [(scored[i] >= 0.5) == bool(t) for i, _, t in rows[1000:]]
    assert np.mean(right) > 0.95
    got = rows_of(score_toxicity(features, df))
    assert len(got) == features.count() and all(0 <= r["score"] <= 1 for r in got)
    assert {r["score"] for r in rows_of(score_toxicity(features, df.limit(0)))} == {0.5}
    assert score_toxicity(empty, df).count() == 0


def test_toxicity_does_not_hang_on_the_number_of_labels(spark):
    rng = np.random.default_rng(9)
    words = [f"w{i}" for i in range(300)]

    def text(toxic):
        # bad words are commoner in toxic texts, but no certain mark
        return " ".join([*rng.choice(words, 30), *(f"bad{k}" for k in range(6) if rng.random() < (0.5 if toxic else 0.2))])

    rows = [(i, text(i % 10 == 0), int(i % 10 == 0)) for i in range(1500)]
    many = [(i + 1500 * k, t, y) for k in range(20) for i, t, y in rows]
    schema = "feature_id long, description string, toxic int"
    asked = spark.createDataFrame([(-1 - i, text(i % 10 == 0), int(i % 10 == 0)) for i in range(400)], schema)
    got = []
    for labelled in (rows, many):
        df = spark.createDataFrame(labelled, schema)
        scored = rows_of(score_toxicity(df.unionByName(asked), df, sample=3000).where("feature_id < 0"))
        got.append(np.array([r["score"] for r in sorted(scored, key=lambda r: r["feature_id"])]))
    means, flagged = [x.mean() for x in got], [(x >= 0.5).mean() for x in got]
    assert abs(means[0] - means[1]) < 0.04 and abs(flagged[0] - flagged[1]) < 0.05


def personal(x):
    def luhn(s):
        d = [int(c) for c in s if c.isdigit()][::-1]
        return 16 <= len(d) <= 19 and sum(c if i % 2 == 0 else 2 * c - 9 * (c > 4) for i, c in enumerate(d)) % 10 == 0

    forms = [
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
        ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(p) <= 255 for p in m.split("."))),
        ("card", r"[0-9]([\x20-]?[0-9])+", luhn), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 8 <= sum(c.isdigit() for c in m) <= 15),
    ]
    return [(k, m.start(), m.end()) for k, p, ok in forms for m in re.finditer(p, x or "") if ok(m[0])]


def test_personal(spark, features, empty):
    odd = ["1.2.3.4.5.6.7.8 256.1.1.1 0001.02.3.004", "4111-1111-1111-1111 4111  1111 4111 1111 1111 1112", "+12 (3) 456-7890 +1234", "a@b a@b.c. x.@y-z.co..uk", "日本 é 4111111111111111 😀 +1 202 555 0147 token = \"0a1b2c3d4e5f60718293a4b5c6d7e8f901234567\"", "7" * 30_000, "1 " * 20_000, "5-" * 9000, "a@" + "b." * 20_000 + "c"]
    df = features.select("feature_id", "description").unionByName(spark.createDataFrame([(100 + i, t) for i, t in enumerate(odd)], "feature_id long, description string"))
    texts = [r.description for r in df.orderBy("feature_id").collect() if r.feature_id is not None]
    for r, t in zip(sorted((r for r in rows_of(personal_spans(df)) if r["feature_id"] is not None), key=lambda r: r["feature_id"]), texts):
        assert [(s["kind"], s["start"], s["stop"]) for s in r["base"]] == personal(t)
        assert r["spans"][: len(r["base"])] == r["base"]
    red = {r["feature_id"]: r["redacted"] for r in rows_of(redact_descriptions(df))}
    assert red[0] is None and red[1] == "" and "555-0147" not in red[11] and "[email]" in red[11] and "[card]" in red[104]
    assert personal_spans(empty).count() == 0 and redact_descriptions(empty).count() == 0


def test_personal_beyond_the_given_form(spark):
    rng = np.random.default_rng(8)
    prose = lambda: " ".join(rng.choice(["relay", "mast", "valley", "the", "of", "harbour"], 12))
    private = [
        "api_key=9f8e7d6c5b4a39281706f5e4d3c2b1a7", "password=Winter99Blue", "202-555-0188", "457-55-5462", "DE44500105175407324931", "GB33 BUKB 2020 1555 5555 55",
        "mary.s (at) radio.example.com", "client_secret: 'q8Zr27LmX0vT55kP'",
    ]
    public = ["2023-11-05 12", "30 000 000", "linux-x86_64-release-77"]
    texts = [f"{prose()} {x} {prose()}" for x in private + public]
    hexes = [f'{prose()} token = "{"".join(rng.choice(list("0123456789abcdef"), 40))}" {prose()} +1 202 555 01{i:02d} {prose()} 2021-03-04 10 {prose()}' for i in range(40)]
    df = spark.createDataFrame(list(enumerate(texts + hexes)), "feature_id long, description string")
    red = {r["feature_id"]: r["redacted"] for r in rows_of(redact_descriptions(df))}
    values = ["9f8e7d6c5b4a39281706f5e4d3c2b1a7", "Winter99Blue", *private[2:7], "q8Zr27LmX0vT55kP"]
    assert [v for i, v in enumerate(values) if v in red[i]] == []
    assert [x for i, x in enumerate(public, len(private)) if x not in red[i]] == []
    assert all('token = "[secret]"' in red[len(texts) + i] for i in range(40))


def test_personal_unions(spark):
    from rfcover.llm.personal import _unions

    spans = [("c", 9, 30), ("a", 0, 5), ("b", 4, 10), ("d", 40, 44), ("e", 44, 50), ("f", 40, 43)]
    got = spark.createDataFrame([(spans,), ([],)], "p array<struct<kind:string,start:int,stop:int>>").select(_unions(F.col("p")).alias("u")).collect()
    assert [tuple(s) for s in got[0].u] == [("a", 0, 30), ("d", 40, 44), ("e", 44, 50)] and got[1].u == []

    # a secret with a phone number inside goes whole
    texts = [f'token = "0a1b2c3d4e5f6071{i:02d}+31201234567{i:02d}9ab8c7d6" on the mast' for i in range(30)]
    red = rows_of(redact_descriptions(spark.createDataFrame(list(enumerate(texts)), "feature_id long, description string")))
    assert all("0a1b2c3d" not in r["redacted"] and "c7d6" not in r["redacted"] for r in red)


def test_trees_learn_from_every_proposal(spark, monkeypatch):
    from rfcover.llm import personal

    staged, keep = {}, personal.stage

    def kept(df, name):
        staged[name] = keep(df, name)
        return staged[name]

    monkeypatch.setattr(personal, "stage", kept)
    texts = spark.range(6500).selectExpr("id AS feature_id", "concat('row ', 1000000 + id * 37, ' of the list') AS description")
    _, threshold = personal.train_trees(texts)
    assert staged["span-proposals"].agg({"times": "sum"}).first()[0] == 6500
    assert 0.5 <= threshold <= 1.0
