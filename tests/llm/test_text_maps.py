"""Operators that map texts one by one: secrets, BPE, token counts, HTML."""

from __future__ import annotations

import hashlib
import random
import re
import tracemalloc

import pyarrow as pa
import pytest

from lodestone.llm import bpe, html_extract, piece_counts, secrets

SHA = lambda s: hashlib.sha256(s.encode()).hexdigest()


def base_by_contract(text):
    found = []
    for m in re.finditer(r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text):
        if len(m[2]) >= 6:
            found.append((m.start(), 0, m.end()))
    for m in re.finditer(r"AKIA[A-Z0-9]+", text):
        if len(m[0]) >= 20:
            found.append((m.start(), 1, m.end()))
    for m in re.finditer(r"[0-9a-f]+", text):
        if len(m[0]) >= 24:
            found.append((m.start(), 2, m.end()))
    return sorted(found)


def test_secret_scan(spark, folder):
    rng = random.Random(3)
    parts = ["password", "TOKEN", "ſecret", "api_key", "apiKey", "=", ":", " ", '"', "'", "abc", "secret=token:abcdefgh", "AKIA", "ABCDEFGH1234567890", "0123456789abcdef", "é", "\n", "xyz.+/=", "AKIAAKIA"]
    docs = [(i, "".join(rng.choice(parts) for _ in range(rng.randint(0, 40)))) for i in range(300)]
    docs += [(300, None), (301, ""), (302, "x" * 200_000 + " token = 'abcdef1'"), (7, docs[7][1]), (None, "passwd=letmein1")]
    rows = secrets.query(spark, folder(docs)).collect()
    assert len(rows) == len(docs)
    texts = {}
    for i, t in docs:
        texts.setdefault(i, t or "")
    for r in rows:
        want = base_by_contract(texts[r.doc_id])
        assert [r.n_assign, r.n_access, r.n_hex] == [sum(k == j for _, k, _ in want) for j in range(3)]
        text = ",".join(f"{secrets.KINDS[k]}:{a}:{b}" for a, k, b in want)
        assert r.base_sha256 == SHA(text)
        assert set(filter(None, text.split(","))) <= set(r.spans.split(","))
    assert secrets.query(spark, folder([])).count() == 0


def test_lexer_propagates_constants_and_scores_names():
    found = lambda t: [t[a:b] for a, _, b in secrets.lexed_spans(t)]
    assert found('K = "AbC9xy12Zq88"\nclient_password = K') == ["AbC9xy12Zq88"]
    assert found('access_token: "a1b2c3d4" + "E5F6g7h8"') == ["a1b2c3d4", "E5F6g7h8"]
    assert found('color = "AbC9xy12Zq88"') == []
    assert found('password = "your-password-here"') == []
    assert found("password_length = 12345678") == []


def test_redaction_keeps_the_rest(spark, folder):
    text = 'before token = "04dbebab91ab85687d33eeaa" after'
    df = spark.read.parquet(folder([(1, text), (2, None), (3, "clean")]) + "/documents.parquet")
    got = {r.doc_id: r.text for r in secrets.redact(df).collect()}
    assert got == {1: 'before [SECRET]" after', 2: None, 3: "clean"}


def test_bpe_is_the_tokenizer(spark, folder):
    tokenizers = pytest.importorskip("tokenizers")
    own = tokenizers.Tokenizer.from_file(bpe.public_vocabulary())
    rng = random.Random(5)
    docs = [(i, "".join(rng.choice("it's 'S re'll\n  \tdon1 !véh漢😀　 \x00") for _ in range(rng.randint(0, 60)))) for i in range(400)]
    docs += [(400, None), (401, ""), (402, "a<|endoftext|> b<|endoftext|><|endoftext|>"), (403, "ha" * 5000), (404, " " * 3000 + "x"), (5, docs[5][1])]
    first = {}
    for i, t in docs:
        first.setdefault(i, t or "")
    rows = bpe.query(spark, folder(docs)).collect()
    assert len(rows) == len(docs)
    for r in rows:
        ids = own.encode(first[r.doc_id], add_special_tokens=False).ids
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == SHA(",".join(map(str, ids)))
        assert r.decoded_sha256 == SHA(own.decode(ids, skip_special_tokens=False))
    assert bpe.query(spark, folder([])).count() == 0


def thue_morse(n):
    return "".join("ab"[bin(i).count("1") & 1] for i in range(n))


def test_long_words_of_equal_sums_stay_apart(spark, folder):
    tokenizers = pytest.importorskip("tokenizers")
    own = tokenizers.Tokenizer.from_file(bpe.public_vocabulary())
    words = [w for n in (1024, 2048) for w in (thue_morse(n), thue_morse(n).translate(str.maketrans("ab", "ba")))]
    docs = [(i, w) for i, w in enumerate([*words, " ".join(words)])]
    with open(piece_counts.public_vocabulary(), "rb") as f:
        counter = piece_counts.Counter(piece_counts.ordinary_pieces(f.read()))
    counts = {r.doc_id: r.n_pieces for r in piece_counts.query(spark, folder(docs)).collect()}
    for r in bpe.query(spark, folder(docs)).collect():
        assert r.ids_sha256 == SHA(",".join(map(str, own.encode(docs[r.doc_id][1], add_special_tokens=False).ids)))
        assert r.decoded_sha256 == SHA(docs[r.doc_id][1])
        assert counts[r.doc_id] == sum(counter.word("▁" + w) for w in docs[r.doc_id][1].split())


def test_distinct_compares_contents(monkeypatch):
    from lodestone.llm import text_arrays

    np = text_arrays.np
    data = np.frombuffer(b"abcabdabcxabc" + b"y" * 1300, np.uint8)
    start, end = np.array([0, 3, 6, 10, 13, 663, 2]), np.array([3, 6, 9, 13, 663, 1313, 3])
    for weak in (False, True):
        if weak:
            monkeypatch.setattr(text_arrays, "prints", lambda d, a, b, seed=0: np.zeros(len(a), np.uint64))
        first, inverse = text_arrays.distinct(data, start, end)
        name = [bytes(data[a:b]) for a, b in zip(start, end, strict=True)]
        assert len(first) == 4 and [name[first[i]] for i in inverse] == name


def test_bpe_round_trip(spark, folder):
    df = spark.read.parquet(folder([(1, "naïve 漢字 text"), (2, ""), (3, None)]) + "/documents.parquet")
    ids = bpe.encode(df, bpe.public_vocabulary(), keep_ids=True)
    back = {r.doc_id: r.text for r in bpe.decode(ids.select("doc_id", "ids"), bpe.public_vocabulary()).collect()}
    assert back == {1: "naïve 漢字 text", 2: "", 3: ""}
    clash = bpe.decode(ids.selectExpr("ids", "doc_id AS text"), bpe.public_vocabulary())
    assert clash.columns == ["ids", "text"] and {r.text for r in clash.collect()} == set(back.values())


def brute_pieces(word, scores, unknown):
    """Best score, then pieces in the order in which a forward pass finds them."""
    best = {0: (0.0, 0)}
    for at in range(len(word)):
        ends = [e for e in range(at + 1, len(word) + 1) if word[at:e] in scores]
        for e in ends:
            total = best[at][0] + scores[word[at:e]]
            if e not in best or total > best[e][0]:
                best[e] = (total, best[at][1] + 1)
        if at + 1 not in ends:
            total = best[at][0] + unknown
            if at + 1 not in best or total > best[at + 1][0]:
                best[at + 1] = (total, best[at][1] + len(word[at].encode()))
    return best[len(word)][1]


def test_token_counts(spark, folder):
    with open(piece_counts.public_vocabulary(), "rb") as f:
        pieces = piece_counts.ordinary_pieces(f.read())
    scores, unknown = dict(pieces), min(s for _, s in pieces) - 10
    docs = [(1, "Hello world  and   more"), (2, None), (3, ""), (4, "漢字😀 tions"), (5, " x\ny "), (6, "word " * 20_000), (1, "Hello world  and   more")]
    got = {r.doc_id: r.n_pieces for r in piece_counts.query(spark, folder(docs)).collect()}
    for i, t in docs:
        marked = "▁" + t.replace(" ", "▁") if t else ""
        assert got[i] == sum(brute_pieces(w, scores, unknown) for w in re.findall("▁+[^▁]*", marked))
    assert piece_counts.query(spark, folder([])).count() == 0


def pages(rows):
    return pa.table({"page_id": pa.array([r[0] for r in rows], pa.int64()), "url": pa.array([r[1] for r in rows], pa.string()), "html": pa.array([r[2] for r in rows], pa.string()), "text": pa.array([0] * len(rows), pa.int64())})


def test_html_extraction(spark, folder):
    article = "<article><h1>A  title</h1><p>One &amp; two&nbsp;three.<br>Four.<p>Last <b>one</b> here &lt;x&gt;.</p></article>"
    around = "<html><head><title>T</title><style>p{color:red}</style></head><body><nav><ul><li><a href='/'>Home</a></li></ul></nav>ARTICLE<div class='comments'><h2>Replies</h2><div class='comment'><p>I agree with all.</p></div></div><footer>&copy; me</footer><script>var a='<p>no</p>';</script></body></html>"
    whole = around.replace("ARTICLE", article)
    rows = [(1, "u", whole), (2, None, None), (3, "u", ""), (4, "u", whole[: around.index("ARTICLE") + 60]), (1, "u", whole)]
    got = html_extract.query(spark, folder(pages=pages(rows))).collect()
    assert len(got) == 5
    by = {r.page_id: r for r in got}
    assert by[1].text == "A title\n\nOne & two three. Four.\n\nLast one here <x>." and by[1].n_chars == len(by[1].text)
    assert by[2].text == by[3].text == "" and by[2].n_chars == 0
    assert by[4].text.startswith("A title")
    assert html_extract.query(spark, folder(pages=pages([]))).count() == 0


def test_html_field_on_held_out_pages():
    labelled = html_extract.labelled_pages(160, seed=9)
    field = html_extract.fit(html_extract.labelled_pages(200, seed=4))
    right = total = 0
    for found, labels in labelled:
        row, feature = html_extract.features(found)
        unary = html_extract.np.bincount(row, field.weights[feature], len(found)) + field.bias
        right += sum(int(a) == b for a, b in zip(html_extract.viterbi(field, unary), labels, strict=True))
        total += len(labels)
    assert right / total > 0.95


def test_secrets_of_far_names_and_wide_gaps():
    for text in ("client_" + "x" * 400 + '_password = "AbC9xy12Zq88"', 'client_password' + " " * 300 + '= "AbC9xy12Zq88"', "client_password =" + " " * 200 + '"AbC9xy12Zq88"'):
        assert [text[a:b] for a, _, b in secrets.lexed_spans(text)] == ["AbC9xy12Zq88"]


def test_token_counts_of_an_empty_vocabulary():
    assert piece_counts.Counter([]).texts(["ab", ""]).tolist() == [3 + 2, 0]


def test_secrets_of_many_parts_lines_and_words():
    from lodestone.llm import secrets

    key = [f"Qx{i}z7Kp{i}" for i in range(20)]
    joined = 'secret_key = "' + '" + "'.join(key) + '"'
    lines = 'private_key = "' + '" +\n      "'.join(key) + '"'
    before = 'api_secret = "' + '"\n  + "'.join(key) + '"'
    constant = 'part = "' + '" + "'.join(key) + '"\nclient_secret = part + "Tail9xQ"'
    for text, more in ((joined, []), (lines, []), (before, []), (constant, ["Tail9xQ"])):
        assert {text[a:b] for a, _, b in secrets.lexed_spans(text)} == {*key, *more}, text
    for value in ("MyDog$2019xQ9", "TheRain#88kZq", "none7Qx!pLm2"):
        text = f'pwd = "{value}"'
        assert [text[a:b] for a, _, b in secrets.lexed_spans(text)] == [value]
    for value in ("my_password_here", "changeme", "your-token-goes-here", "none"):
        assert not secrets.lexed_spans(f'pwd = "{value}"')
    doubling = 'a = "Zk91xQpL"\n' + "a = a + a\n" * 60 + "password = a"
    assert [doubling[a:b] for a, _, b in secrets.lexed_spans(doubling)] == ["Zk91xQpL"]


def test_summaries_of_values_add_up():
    rng = random.Random(11)
    for _ in range(300):
        parts = ["".join(rng.choice("abC1- é\t,") for _ in range(rng.randint(0, 12))) for _ in range(rng.randint(2, 5))]
        total, whole = secrets.Summary.of(parts[0]), "".join(parts)
        for part in parts[1:]:
            total += secrets.Summary.of(part)
        want = secrets.Summary.of(whole)
        for name in ("length", "head", "kinds", "chars"):
            assert getattr(total, name) == getattr(want, name)
        assert total.words == want.words if whole.strip() else total.words == 0
        assert total.variety >= want.variety - 1e-9


def test_lexing_long_texts_takes_little_memory():
    for line in ("k = a.b.c + k\n", "a = b + ", "k = k + k\n", 'password = "a1B2" + k\nk = password\n'):
        text = line * (300_000 // len(line))
        tracemalloc.start()
        spans = secrets.lexed_spans(text)
        most = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert most < 30 << 20 and (len(spans) > 1000) == ("password" in line)


def test_a_sum_without_bound_is_weighed_whole():
    text = "".join(f'part{i} = "{c}{i % 10}"\n' for i, c in enumerate("aBcDeFgHiJ")) + "all = " + " + ".join(f"part{i}" for i in range(10)) + "\n" + "filler = x + filler\n" * 3000 + "token = all + filler\n"
    assert {text[a:b] for a, _, b in secrets.lexed_spans(text)} >= {f"{c}{i}" for i, c in enumerate("aBcDeFgHiJ")}


def test_token_counts_of_long_words_by_a_window():
    rng = random.Random(5)
    pieces = [("".join(rng.choice("abc") for _ in range(rng.randint(1, 6))), -float(rng.randint(1, 9))) for _ in range(40)]
    own = piece_counts.Counter(list(dict(pieces).items()))
    for size in (1, 2, 7, 400, 5000):
        word = "".join(rng.choice("abcdé") for _ in range(size))
        best = [(0.0, 0)] + [None] * size
        for end in range(1, size + 1):
            for begin in range(max(0, end - 6), end):
                score = dict(pieces).get(word[begin:end])
                if score is None and end - begin == 1:
                    score = own.unknown
                if score is not None and (best[end] is None or best[begin][0] + score > best[end][0]):
                    best[end] = best[begin][0] + score, best[begin][1] + (len(word[begin:end].encode()) if dict(pieces).get(word[begin:end]) is None else 1)
        assert own.word(word) == best[size][1]
    tracemalloc.start()
    own.word("abcd" * 100_000)
    assert tracemalloc.get_traced_memory()[1] < 4 << 20  # the text itself takes most of it
    tracemalloc.stop()
