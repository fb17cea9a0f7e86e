"""Language ID, toxicity, personal data, chat windows, fingerprints, mixing, packing."""

import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from siftrank.llm import chat, language, packing, pii, toxicity
from siftrank.llm.fingerprint import difference, fingerprints, likeness, with_next
from siftrank.llm.mixing import mix_sources
from tests.llm.helpers import EDGE_SCHEMA, edge_rows


def plain_phrases(sample, text):
    """Greedy longest matches, a letter that the sample lacks being a phrase end."""
    count, phrase = 1, ""
    for c in text:
        if phrase + c in sample:
            phrase += c
        else:
            count += 1
            phrase = c if c in sample else ""
    return count


def test_cross_parsing_counts_phrases():
    draw = random.Random(2)
    sample = "".join(draw.choice("abc ") for _ in range(300))
    sample = " ".join(sample.split())
    model = language.build({"x": sample, "y": "abc abd"})
    parser = language.Parser(model)
    texts = ["".join(draw.choice("abcq ") for _ in range(n)) for n in (0, 1, 5, 200, language.PIECE * 2 + 7)]
    phrases, sizes, letters = parser.parse(texts)
    for text, got, n in zip(texts, phrases, letters):
        code = " ".join(text.split()) + " " if text.strip() else ""
        pieces = [code[i:i + language.PIECE] for i in range(0, len(code), language.PIECE)]
        assert got[0] == sum(plain_phrases(sample, p) for p in pieces)
        assert n == sum(c != " " for c in text)


def test_language_of_edge_rows(spark):
    docs = spark.createDataFrame(edge_rows(), EDGE_SCHEMA)
    got = language.identify(docs, language.fit(docs)).collect()
    assert len(got) == len(edge_rows())
    assert all((r.lang_pred == "und") == (r.letters == 0) and 0 <= r.score <= 1 for r in got)
    untaught = language.identify(docs, language.fit(docs.where("false"))).collect()
    assert {(r.lang_pred, r.score) for r in untaught} == {("und", 0.0)}
    assert language.identify(docs.where("false"), language.fit(docs)).count() == 0


def test_more_languages_than_a_model_holds(spark):
    rows = [(10 * i + j, f"{chr(0x4e00 + 40 * i)}{chr(0x4e01 + 40 * i)} {chr(0x4e02 + 40 * i)} text {j}", f"l{i:02}")
            for i in range(70) for j in range(1 if i in (3, 5, 8, 60, 61, 62) else 2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language.fit(docs)
    assert sorted(model.languages) == [f"l{i:02}" for i in range(70) if i not in (3, 5, 8, 60, 61, 62)]
    assert language.fit(docs, max_languages=66).languages[:6] == ["l00", "l01", "l02", "l03", "l04", "l05"]
    assert language.identify(docs, model).count() == len(rows)


def plain_segments(w):
    best = max(((sum(w[i:j]), -(j - i), i, j) for i in range(len(w)) for j in range(i + 1, len(w) + 1)), default=(0,))
    if best[0] <= 0:
        return []
    _, _, i, j = best
    return plain_segments(w[:i]) + [(i, j)] + [(a + j, b + j) for a, b in plain_segments(w[j:])]


def test_all_maximal_segments():
    draw = random.Random(4)
    for _ in range(400):
        w = [draw.choice([-3, -2, -1, 1, 2, 3]) + draw.random() / 100 for _ in range(draw.randrange(12))]
        assert [s[:2] for s in toxicity.segments(np.array(w))] == plain_segments(w)


def test_toxicity_learns_and_marks_passages(spark):
    draw = random.Random(6)
    rows, labels = [], []
    for i in range(600):
        text = [f"w{draw.randrange(400)}" for _ in range(60)]
        if bad := i % 4 == 0:
            text[20:23] = ["Rotten", "rotter,", "é"]
        rows.append((i, " ".join(text)))
        labels.append((i, int(bad)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    marks = spark.createDataFrame(labels, "doc_id long, toxic int")
    model = toxicity.fit(docs.where("doc_id % 5 <> 0"), marks)
    got = {r.key: r for r in toxicity.score_toxicity(docs, model).collect()}
    held = [i for i in range(600) if i % 5 == 0]
    assert sum((got[i].score >= 0.5) == (i % 4 == 0) for i in held) >= 0.98 * len(held)
    passage = got[0].passages[0]
    assert "Rotten" in rows[0][1][passage.start:passage.end]
    edge = toxicity.score_toxicity(spark.createDataFrame(edge_rows(), EDGE_SCHEMA), model).collect()
    assert len(edge) == len(edge_rows()) and all(0 <= r.score <= 1 for r in edge)
    untaught = toxicity.fit(docs, marks.where("false"))
    assert len({r.score for r in toxicity.score_toxicity(docs.limit(5), untaught).collect()}) == 1


def test_a_shared_licence_line_does_not_replace_labels(spark):
    """All texts hold one line and are otherwise their own; the toxic ones are a minority and still teach."""
    line = "permission is granted to use and copy this file"
    rows = [(i, f"{line} {' '.join(f'w{i * j % 211} {word}' for j, word in enumerate(words * 4, 1))}")
            for i in range(200) for words in [["vile", "filth", "scum"] if i % 4 == 1 else ["fair", "kind", "nice"]]]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    marks = spark.createDataFrame([(i, int(i % 4 == 1)) for i in range(0, 200) if i % 5], "doc_id long, toxic int")
    got = {r.key: r.score for r in toxicity.score_toxicity(docs, toxicity.fit(docs, marks)).collect()}
    assert min(got[i] for i in got if i % 4 == 1) > max(got[i] for i in got if i % 4 != 1)


def test_copies_weigh_as_one_text(spark):
    """A text with 300 copies moves the model as one would, ids that repeat included."""
    base = [(i, f"word{i} other{i * 7} thing{i * 3} place{i % 9} filler{i % 5} {'vile' if i % 3 == 0 else 'fair'}") for i in range(60)]
    marks = [(i, int(i % 3 == 0)) for i in range(60)]
    more = [(1000 + i // 2, base[0][1]) for i in range(600)]
    plain = toxicity.fit(spark.createDataFrame(base, "doc_id long, text string"), spark.createDataFrame(marks, "doc_id long, toxic int"))
    copied = toxicity.fit(spark.createDataFrame(base + more, "doc_id long, text string"),
                          spark.createDataFrame(marks + [(1000 + i, 1) for i in range(300)], "doc_id long, toxic int"))
    assert np.abs(plain.weights - copied.weights).max() < 0.01


def _hand_model(*toxic):
    """A model that gives 1 to the given tokens, -1 to all others, and the plain law exp(-sum) * tokens."""
    hasher = toxicity.token_hasher()
    weights = np.full(1 << toxicity.BUCKET_BITS, -1.0, np.float32)
    weights[toxicity._bucket(hasher.words([" ".join(toxic).encode()]).hash)] = 1.0
    return toxicity.Model(weights, rate=1.0, scale=1.0)


def test_every_significant_passage_is_listed():
    """One strong passage, two weaker ones and a chance hit; and a clean text with a chance hit."""
    gap = ["the"] * 40
    text = [*gap, *["vile"] * 60, *gap, *["vile"] * 15, *gap, "vile", *gap, *["vile"] * 15, *gap]
    clean = [*gap, *["vile"] * 5, *gap]
    texts = [" ".join(t) for t in (text, clean, gap)]
    scorer = toxicity.Scorer(_hand_model("vile"))
    strong, calm, none = scorer.score([t.encode() for t in texts])
    assert [texts[0][a:b].split() for a, b, _ in strong[1]] == [["vile"] * n for n in (60, 15, 15)]
    assert [a for a, _, _ in strong[1]] == sorted(a for a, _, _ in strong[1])
    assert all(x < toxicity.LEVEL for _, _, x in strong[1])
    assert calm[1] == none[1] == [] and calm[0] > none[0] == 0
    every = list(toxicity.Scorer(_hand_model("vile"), level=math.inf).score([texts[0].encode()]))
    assert len(every[0][1]) == 4 and every[0][0] == strong[0]  # the level leaves the evidence alone


def test_tokens_cover_every_byte():
    hasher = toxicity.token_hasher()
    texts = ["die Hunde, x", "abc漢字かな def ไทย。 é", "привет мир", "漢", "", "😀😀a", "x漢y 字z"]
    words = hasher.words([t.encode() for t in texts])
    got = [[words.data[a:b].decode() for a, b in zip(words.start[i:j], words.end[i:j])]
           for i, j in zip(words.first[:-1], words.first[1:])]
    assert got == [["die", "Hunde", "x"], ["abc", "漢字か", "字かな", "かな", "な", "def", "ไทย", "ทย。", "ย。", "。", "é"],
                   ["привет", "мир"], ["漢"], [], ["😀😀", "😀", "a"], ["x", "漢", "y", "字", "z"]]
    flat = [w for row in got for w in row]
    features = [[] for _ in flat]
    for bucket, own in hasher.features(words):
        for i in np.flatnonzero(own):
            features[i].append(bucket[i])
    alone = lambda t: toxicity._bucket(hasher._piece(np.frombuffer(t.lower().encode(), np.uint8))[2])[0]
    assert features[flat.index("привет")] == [alone("прив"), alone("приве"), alone("привет")]
    assert features[flat.index("Hunde")] == [alone("Hund"), alone("Hunde")] and len(features[flat.index("x")]) == 1
    assert len(features[flat.index("字かな")]) == 2 and len(features[flat.index("かな")]) == 1
    broken = hasher.words([b"\x80\xbfab \xe6\xbc", b"\xff\xf0 \xe6\xbc\xa2\x80\x80\xe6"])
    assert (broken.end > broken.start).all() and all(len(b) == len(broken.start) for b, _ in hasher.features(broken))


def test_toxicity_learns_what_only_the_rest_of_a_token_tells(spark):
    """Long tokens that differ after their stems, Chinese and Thai without spaces, Cyrillic and Greek."""
    draw = random.Random(7)
    pairs = {"latin": ("unbelievablyvile", "unbelievablykind", " "), "greek": ("καταραμενος", "καταλαβαινω", " "),
             "cyrillic": ("проклятый", "проклассный", " "), "chinese": ("混蛋去死", "早安你好", ""), "thai": ("เลวมากไป", "ดีใจจังค", "")}
    letters = {"latin": "abcdefgh", "greek": "αβγδεζηθ", "cyrillic": "абвгдежз", "chinese": "天地人山水火木金土日月", "thai": "กขคงจฉชซ"}
    rows, labels = [], []
    for kind, (bad, good, space) in pairs.items():
        for i in range(240):
            text = ["".join(draw.choice(letters[kind]) for _ in range(3)) for _ in range(40)]
            text[20:20] = [bad if i % 4 == 0 else good] * 2
            labels.append((len(rows), int(i % 4 == 0)))
            rows.append((len(rows), space.join(text), kind))
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    model = toxicity.fit(docs.where("doc_id % 5 <> 0"), spark.createDataFrame(labels, "doc_id long, toxic int"))
    got = {r.key: r for r in toxicity.score_toxicity(docs, model).collect()}
    for kind, (bad, _, _) in pairs.items():
        held = [(i, text) for i, text, k in rows if k == kind and i % 5 == 0]
        right = sum((got[i].score >= 0.5) == labels[i][1] for i, _ in held)
        assert right >= 0.95 * len(held), (kind, right, len(held))
        for i, text in held:
            if labels[i][1]:
                assert any(p.start < text.index(bad) + 2 * len(bad) and p.end > text.index(bad) for p in got[i].passages), kind


BASE_FORMS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def plain_spans(text):
    def valid(kind, s):
        digits = re.sub("[^0-9]", "", s)
        return {"email": True, "ip": kind == "ip" and all(int(p) <= 255 for p in s.split(".")),
                "card": 16 <= len(digits) <= 19 and pii.luhn(digits), "phone": 8 <= len(digits) <= 15}[kind]
    return [(k, *m.span()) for k, p in BASE_FORMS.items() for m in re.finditer(p, text) if valid(k, m.group())]


def test_base_spans_equal_the_patterns():
    draw, finder, found = random.Random(8), pii.Finder(), 0
    for letters in ("0123456789.", "0 1.-+@a", "a@.b", "+1 (2).3-x", "12.3@ +-", "59 -.0"):
        for _ in range(3000):
            text = "".join(draw.choice(letters) for _ in range(draw.randrange(40)))
            got = [s for s in finder.spans(text) if s[0] in pii.BASE]
            assert got == plain_spans(text), text
            found += len(got)
    assert found > 500


def test_added_spans_and_redaction(spark):
    text = "é IBAN: DE89 3704 0044 0532 0130 00, IBAN DE88 3704 0044 0532 0130 00; http://bob:pw@host.org/x a@b.org"
    rows = spark.createDataFrame([(1, text), (2, None), (None, "")], "doc_id long, text string")
    found = pii.find_pii(rows)
    got = {r.key: r.spans for r in found.collect()}
    assert [text[s.start:s.end] for s in got[1] if s.kind == "account"] == ["DE89 3704 0044 0532 0130 00"]
    assert [text[s.start:s.end] for s in got[1] if s.kind == "address"] == ["http://bob:pw@host.org/x"]
    assert got[2] == [] and got[None] == []
    clean = rows.join(found, rows.doc_id == found.key).where("doc_id = 1").select(pii.redact(F.col("text"), F.col("spans"))).first()[0]
    assert clean.startswith("é IBAN: [ACCOUNT], IBAN DE88") and clean.endswith("[ADDRESS] [EMAIL]")
    assert pii.find_pii(spark.createDataFrame(edge_rows(), EDGE_SCHEMA)).count() == len(edge_rows())


def test_chat_escape_round_trip():
    draw = random.Random(9)
    for _ in range(2000):
        text = "".join(draw.choice(["\\", "<", "|", "|>", "[INST]", "</s>", "<s>", "\n", "end", "é", "<|end|>", "s>", "</"])
                       for _ in range(draw.randrange(12)))
        form = chat.escape(text)
        assert chat.unescape(form) == text and not any(c in form for c in chat.CONTROL)


@pytest.mark.parametrize("budget", [1, 20, 60, 1000])
def test_chat_windows(spark, budget):
    draw, talks = random.Random(budget), defaultdict(list)
    for conv in [1, 2, 3, 4, None]:
        for turn in range(draw.choice([1, 2, 25])):
            role = "system" if turn == 0 and conv in (1, 4) else draw.choice(["user", "assistant", "a\nb", None])
            text = draw.choice([None, "", "</s>[INST] ok [/INST]", "some words here", "x " * 30, "back\\slash <|end|>\n"])
            talks[conv].append((conv, turn, role, text))
    rows = spark.createDataFrame([r for t in talks.values() for r in t], "conv_id long, turn long, role string, text string")
    windows = chat.format_chat(rows.repartition(3), budget=budget, history_turns=2, history_tokens=12)
    got = {r.conv_id: r for r in chat.read_back(windows).collect()}
    assert set(got) == set(talks)
    for conv, turns in talks.items():
        said = [(r or "", t or "") for _, _, r, t in turns]
        target = "".join(t for r, t in said if r == "assistant")
        r = got[conv]
        assert (r.n_turns, r.loss_chars) == (len(said), len(target))
        assert r.turns_sha256 == hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in said).encode()).hexdigest()
        assert r.loss_sha256 == hashlib.sha256(target.encode()).hexdigest()
    for w in windows.collect():
        system = [x for x in talks[w.conv_id][:1] if x[2] == "system"]
        assert w.tokens <= budget or w.n_turns - w.n_repeated == 1
        assert w.window == 0 or not system or chat.parse(w.text)[0][0] == "system"
        assert w.n_repeated <= 2 + len(system)
    assert chat.format_chat(rows.where("false")).count() == 0


def test_next_rows_at_many_partitions(spark):
    """The plan has one size, and rows follow each other alike, for any number of shuffle partitions."""
    docs = spark.range(3000).selectExpr("id * 7 as doc_id", "repeat(cast(id as string), cast(id % 50 as int)) as text").repartition(5)
    rows = sorted(((r.doc_id, r.text) for r in docs.collect()), reverse=True)
    want = {rows[i][0]: rows[(i + 1) % len(rows)][1] for i in range(len(rows))}
    before, sizes = spark.conf.get("spark.sql.shuffle.partitions"), {}
    try:
        for parts in (1, 8, 4000):
            spark.conf.set("spark.sql.shuffle.partitions", parts)
            out = with_next(docs, "doc_id", "text")
            sizes[parts] = len(out._jdf.queryExecution().analyzed().toString().split("\n"))
            assert {r.key: r.next_text for r in out.collect()} == want
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert len(set(sizes.values())) == 1


def test_fingerprints(spark):
    draw = random.Random(10)
    rows = [(i, "\n".join(f"line {draw.randrange(40)} {draw.randrange(9)}" for _ in range(draw.choice([0, 1, 3, 30, 200]))))
            for i in range(40)]
    rows += [(3, "same key"), (None, "no key"), (None, None), (50, rows[5][1]), (51, " \n \n")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = fingerprints(docs).select("*", likeness(F.col("digests"), F.col("next_digests")).alias("near"),
                                    difference(F.col("digests"), F.col("edited_digests")).alias("apart")).collect()
    assert len(got) == len(rows)
    prints = defaultdict(set)
    for r in got:
        a, b = set(r.digests), set(r.next_digests)
        assert math.isclose(r.near, len(a & b) / len(a | b) if a | b else 1.0)
        assert set(r.apart.left) == a - set(r.edited_digests) and set(r.apart.right) == set(r.edited_digests) - a
        prints[r.text].add(r.fingerprint)
    assert all(len(p) == 1 for p in prints.values())
    order = {r.key: r.next_text for r in with_next(docs, "doc_id", "text").collect() if r.key is not None}
    texts = {i: t for i, t in rows if i not in (3, None)}
    assert all(order[i] == texts[i - 1] for i in range(6, 40)) and order[51] == texts[50]
    one = fingerprints(docs.where("doc_id = 7")).first()
    half = len(texts[7]) // 2
    assert one.edited_text == texts[7][: len(texts[7]) - half] + texts[7][:half]
    assert fingerprints(docs.where("false")).count() == 0
    assert fingerprints(spark.createDataFrame(edge_rows(), EDGE_SCHEMA)).count() == len(edge_rows())


def test_mixing(spark):
    docs = spark.range(20000).selectExpr(
        "id as doc_id", "if(id % 3 = 0, 'hot', if(id % 3 = 1, 'b', null)) as source", "repeat('x', 10) as text", "id as copy")
    out = mix_sources(docs, targets={"hot": 1, "b": 2, None: 1})
    share = {r[0]: r[1] for r in out.groupBy("row.source").count().collect()}
    total = sum(share.values())
    assert abs(total - 20000) < 600 and abs(share["b"] / total - 0.5) < 0.02 and abs(share[None] / total - 0.25) < 0.02
    counts = Counter(r.n_copies for r in out.where("row.source = 'b' and copy = 0").collect())
    rate = 1.5
    for k in range(1, 4):
        assert abs(counts[k] / 6667 - math.exp(-rate) * rate**k / math.factorial(k)) < 0.02
    assert {tuple(r) for r in out.collect()} == {tuple(r) for r in mix_sources(docs.repartition(7), targets={"hot": 1, "b": 2, None: 1}).collect()}
    assert mix_sources(docs, targets={"b": 1}).where("row.source <> 'b' or row.source is null").count() == 0
    assert mix_sources(docs.where("false")).count() == 0
    assert mix_sources(spark.createDataFrame(edge_rows(), EDGE_SCHEMA), expansion=3.0).count() > 0


def plain_packing(pieces, capacity, same_source):
    """Bins as lists of (size, source, cluster); the tightest compatible bin, the oldest of equals."""
    bins = []
    for size, source, cluster in pieces:
        fit = [(capacity - sum(p[0] for p in b), i) for i, b in enumerate(bins)
               if sum(p[0] for p in b) + size <= capacity
               and (cluster is None or all(p[2] != cluster for p in b))
               and (source is None or sum(p[1] == source for p in b) < same_source)]
        if fit:
            bins[min(fit)[1]].append((size, source, cluster))
        else:
            bins.append([(size, source, cluster)])
    return bins


@pytest.mark.parametrize("same_source", [1, 3])
def test_packer_takes_the_tightest_compatible_bin(same_source):
    draw = random.Random(same_source)
    pieces = [(draw.randrange(0, 60), draw.choice(["a", "a", "b", None]), draw.choice([None, *range(30)])) for _ in range(400)]
    packer, bins = packing.Packer(100, same_source), defaultdict(list)
    for p in pieces:
        number, slot = packer.place(*p)
        assert slot == len(bins[number])
        bins[number].append(p)
    assert [bins[i] for i in range(len(bins))] == plain_packing(pieces, 100, same_source)


def test_packing_keeps_every_token(spark):
    docs = spark.createDataFrame(edge_rows(), EDGE_SCHEMA)
    plan = packing.pack(docs, packing.count_words(F.col("text")), F.md5("text"), capacity=50, shard_pieces=20).collect()
    assert sum(r.n_tokens for r in plan) == sum(len((r[1] or "").split()) for r in edge_rows())
    filled = Counter()
    for r in plan:
        filled[r.bin] += r.n_tokens
    assert max(filled.values()) <= 50
    assert len({(r.bin, r.slot) for r in plan}) == len(plan) and {r.key for r in plan} == {r[0] for r in edge_rows()}
    assert packing.pack(docs.where("false"), F.lit(1), F.lit("c")).count() == 0


def test_secrets_and_national_numbers():
    finder = pii.Finder()
    found = lambda t: [t[a:b] for k, a, b in finder.spans(t) if k in ("secret", "national")]
    digits = "9f86d081884c7d659a2feaa0c55ad015a3bf4f1b"
    assert found(f'token = "{digits}"') == found(f"API_KEY: {digits}") == found(f"{{'auth_token': '{digits}'}}") == [digits]
    assert found("password = 'hunter2!' and Passwd: \"s3cret,x\"") == ["hunter2!", "s3cret,x"]
    assert found("SSN: 123-45-6789, ssn 900-12-3456, ssn 123-00-6789, Social Security Number 123456789") == ["123-45-6789", "123456789"]
    for clean in ("token = next_token_from_the_stream2(", "tokenizer = aaaaaaaaaaaaaaaa1111", "token: aaaaaaaaaaaaaaaaaaa1", "the secret is out",
                  "password = input()", f"mytoken{digits}", "token", "ssn", "secret =", "token of appreciation for 1234567890123456789"):
        assert found(clean) == [], clean
