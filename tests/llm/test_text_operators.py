"""Text operators of the training-data subpackage: literal cases, brute force, awkward rows."""

import random

import pytest
from pyspark.sql import functions as F

from meguri.llm import boilerplate, language, leakage, lookalikes, residue, tokenize

LONG = "長い文章です。" * 20000


# Encoding -----------------------------------------------------------------------------------------


def reference_encoder():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(f"{tokenize.DEFAULT_TOKENIZERS}/byte_bpe_50k.json")
    t.encode_special_tokens = True
    return t


def test_ids_equal_the_library(sf_dir):
    import pandas as pd

    texts = [t for t in pd.read_parquet(f"{sf_dir}/documents.parquet").text if isinstance(t, str)]
    r = random.Random(1)
    letters = "aé京 \n\t'sll1２.,!?ｱ한😀​\xa0"
    texts += ["".join(r.choice(letters) for _ in range(r.randrange(60))) for _ in range(300)] + ["<|endoftext|>", "a" * 5000, LONG[:3000]]
    ours = tokenize.BytePairEncoder(f"{tokenize.DEFAULT_TOKENIZERS}/byte_bpe_50k.json").encode(texts)
    theirs = reference_encoder().encode_batch(texts, add_special_tokens=False)
    assert [list(map(int, a)) for a in ours] == [b.ids for b in theirs]


def test_ids_of_awkward_rows(spark):
    df = spark.createDataFrame([(1, None, 5), (2, "", 5), (3, " ", 5), (4, LONG, 5), (4, LONG, 5), (None, "x", None)], "doc_id long, text string, ids int")
    got = tokenize.encode_ids(df).collect()
    assert [len(r["ids"]) for r in got[:2]] == [0, 0]
    assert got[3]["ids"] == got[4]["ids"] == reference_encoder().encode(LONG, add_special_tokens=False).ids
    assert got[5]["ids"] == [87]
    assert tokenize.encode_ids(df.limit(0)).count() == 0


# Look-alikes --------------------------------------------------------------------------------------


@pytest.mark.parametrize(
    ("written", "wanted"),
    [
        ("ｶﾞｽﾃﾞﾝ", "ガスデン"),
        ("ガーデン", "ガーデン"),
        ("Café", "Café"),
        ("新​桐里﻿展望台", "新桐里展望台"),
        ("RIVER LAB", "RIVER LAB"),
        ("RΙVER LАB", "RIVER LAB"),
        ("МОSCOW", "MOSCOW"),
        ("センタ一", "センター"),
        ("ロープウェイ", "ロープウェイ"),
        ("ビジターセン夕ー", "ビジターセンター"),
        ("キャ二オンブリッジ", "キャニオンブリッジ"),
        ("キャニオンブりッジ", "キャニオンブリッジ"),
        ("山ロ県", "山口県"),
        ("⼭⼝県", "山口県"),
        ("神社", "神社"),
        ("204–11", "204-11"),
        ("３６０", "360"),
        ("八雲池", "八雲池"),
        ("リゾート八雲坂", "リゾート八雲坂"),
        ("ホテルはなれ", "ホテルはなれ"),
        ("二ツ橋", "二ツ橋"),
        ("八ケ岳", "八ケ岳"),
        ("Москва жд", "Москва жд"),
        ("Γειά σου", "Γειά σου"),
        ("奥\U000e0100山", "奥山"),
        ("Café Étoile", "Café Étoile"),
        ("①㈱", "①㈱"),
        ("Мoсква", "Москва"),
        ("Рoссия и Мoсква", "Россия и Москва"),
        ("Αθήvα", "Αθήνα"),
        ("LАБ", "LАБ"),
        ("می\u200cخواهم", "می\u200cخواهم"),
        ("क्\u200dष", "क्\u200dष"),
        ("山\u200d川", "山川"),
        ("👨\u200d👩\u200d👧", "👨\u200d👩\u200d👧"),
    ],
)
def test_plain_spelling(written, wanted):
    assert lookalikes.plain(written) == wanted
    assert lookalikes.plain(wanted) == wanted


def test_resolved_scripts():
    assert lookalikes.resolved_scripts("LАB") == set()
    assert "Jpan" in lookalikes.resolved_scripts("山のロ")
    assert lookalikes.resolved_scripts("12-3") is None


def test_lookalikes_of_awkward_rows(spark):
    df = spark.createDataFrame([(1, "ＡＢ", "x"), (1, "ＡＢ", "x"), (2, None, None), (3, "", ""), (4, "AB", "y"), (5, "​" + LONG, "z"), (None, "Ａ", None)], "key long, name string, plain string")
    got = {(r["record_key"], r["field"]) for r in lookalikes.find_lookalikes(df, "t", "key", "name").collect()}
    assert got == {("1", "name"), ("5", "name"), (None, "name")}
    assert lookalikes.find_lookalikes(df.limit(0), "t", "key", "name").count() == 0


# Boilerplate --------------------------------------------------------------------------------------

PAGE = """<html><head><title>x</title><style>p{}</style></head><body><nav><ul><li><a href=/>Home</a><li><a href=/m>Maps</a></ul></nav>
<p>The festival begins at 9:00 when the drummers walk past the gate.<p>A second paragraph, <b>bold</b>&nbsp;and plain, ends here.
<p hidden>Not seen by anyone at all.</p><div style="display: none">Nor this one.</div>
<table><tr><th>Day<th>Open<tr><td>Monday<td>9:00 to 17:00</table><ol><li>First take the bus to the harbour.<li>Then walk up the hill to the shrine.</ol>
<p>We use cookies to improve this site. By continuing you accept our cookie policy.</p><footer>© 2024 Town. All rights reserved.</footer></body></html>"""


def test_rendering_of_a_page():
    texts = [b.text for b in boilerplate.render(PAGE)]
    assert "- Home" in texts and "- Maps" in texts
    assert "A second paragraph, bold and plain, ends here." in texts
    assert not any("seen by anyone" in t or "Nor this" in t for t in texts)
    assert "Day     Open\nMonday  9:00 to 17:00" in texts
    assert "1. First take the bus to the harbour." in texts and "2. Then walk up the hill to the shrine." in texts


def test_main_text_of_a_page(spark):
    df = spark.createDataFrame([(PAGE,), (None,), ("",)], "m string")
    out = [r["t"] for r in df.select(boilerplate.main_text(F.col("m")).alias("t")).collect()]
    assert "drummers" in out[0] and "cookie" not in out[0] and "rights" not in out[0] and "Maps" not in out[0]
    assert out[1] is None and out[2] == ""


@pytest.mark.parametrize(
    ("text", "furniture"),
    [
        ("ホーム | 地図 | アクセス | お問い合わせ", True),
        ("トップ > 霧浜 > お知らせ", True),
        ("ページの先頭へ戻る", True),
        ("Pまち歩きの会のメールマガジンに登録すると月二回お得な情報が届きます。", True),
        ("本网站使用Cookie改善您的浏览体验。继续浏览即表示您同意。", True),
        ("저작권 2023 관광협회 무단 전재를 금합니다", True),
        ("Search this site  [        ]  Go  Advanced search", True),
        ("霧浜のクッキー工房では、子どもたちが昼までに30枚の焼き菓子を作ります。", False),
        ("In Asaishi the copyright in the festival song was given to the town hall in 2002.", False),
        ("Visitors share a long table at the canteen and often copy the recipe by hand.", False),
        ("从霧浜坐巴士到柚見大约需要30分钟，沿途十分安静。", False),
    ],
)
def test_furniture(text, furniture):
    assert boilerplate.furniture_text(text) is furniture


@pytest.mark.parametrize(
    ("markup", "wanted"),
    [
        ("<ol><li><a>x</a></li><li><a>x</a></li></ol>", ["1. x", "2. x"]),
        ("<ol start=3><li>a<li value=9>b<li>c</ol>", ["3. a", "9. b", "10. c"]),
        ("<table><caption>Hours</caption><tr><td>Mon<td>9:00<tr><td>Sunday<td>-</table>", ["Hours", "Mon     9:00\nSunday  -"]),
        ("<table>lost<tr><td>a<table><tr><td>b<td>c</table>d</table>", ["lost", "a b c d"]),
        ("<pre>a\n  b\n\nc</pre>d   e", ["a\n  b\n\nc", "d e"]),
        ("<p>a<div>b</p>c</div></div>d", ["a", "bc", "d"]),
        ("<p>one<p>two &amp; three<br>four", ["one", "two & three\nfour"]),
    ],
)
def test_rendering(markup, wanted):
    assert [b.text for b in boilerplate.render(markup)] == wanted


def test_rendering_of_deep_pages():
    deep = "<table><tr><td>" * 3000 + "core" + "</table>" * 3000
    assert [b.text for b in boilerplate.render(deep)] == ["core"]
    assert [b.text for b in boilerplate.render("<div><span>" * 20000 + "core")] == ["core"]
    assert len(boilerplate.render("<ul>" + "<li>x" * 20000)) == 20000


def test_elements_keep_to_their_slots():
    assert boilerplate.judged_slots("</div></body><p>Real text stands here, in a sentence.", ["<nav>Home</nav>", "a < b & c is what the sign says here.", "<div>Home | Maps | Contact</div>"]) == {"description": False, "0": True, "1": False, "2": True}


def test_gate_of_the_act_patterns_loses_nothing(sf_dir):
    import unicodedata

    import pandas as pd

    for ps in pd.read_parquet(f"{sf_dir}/dmo_spots.parquet").body_paragraphs:
        for p in ps if ps is not None else []:
            low = unicodedata.normalize("NFKC", p).lower()
            assert boilerplate.performs_act(low) == bool(boilerplate.ACT.search(low))


def test_furniture_of_awkward_rows(spark):
    rows = [("a", None, None), ("b", "", []), ("c", "Back to top", [None, "", "Real text stands here, in a sentence."]), ("c", "Back to top", [None, "", "Real text stands here, in a sentence."]), ("d", LONG, ["Home | Maps | Contact", LONG]), (None, None, ["Back to top"])]
    df = spark.createDataFrame(rows, "spot_id string, description string, body_paragraphs array<string>").withColumn("slot", F.lit("x"))
    got = {tuple(r) for r in boilerplate.find_furniture(df, "spot_id").collect()}
    assert got == {("c", "description"), ("d", "0"), (None, "0")}
    assert boilerplate.find_furniture(df.limit(0), "spot_id").count() == 0


# Language -----------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def model(sf_dir):
    import pandas as pd

    samples = {}
    for row in pd.read_parquet(f"{sf_dir}/description_rows.parquet").descriptions:
        for k, v in row:
            if k in language.LANGUAGES:
                samples.setdefault(k, []).append(v)
    return language.fit(samples)


def test_forward_sums_all_segmentations(model):
    words = ["ab", "the", "漁", " 港です", " mountain"]
    raw = [w.encode() for w in words]
    got = model.score_words(raw)
    table = {}
    for n, (keys, rows) in enumerate(zip(model.pieces.words, model.pieces.rows, strict=True), 1):
        table |= {(n, int(k)): r for k, r in zip(keys, rows, strict=True)}
    import numpy as np

    longest = len(model.pieces.words)
    assert longest > 8
    row = lambda piece: table.get((len(piece), language.piece_hash(piece)))

    def total(b, k):
        return 1.0 if not b else sum(model.p[row(b[:n]), k] * total(b[n:], k) for n in range(1, min(longest, len(b)) + 1) if row(b[:n]) is not None)

    for i, b in enumerate(raw):
        assert np.allclose(got[i], [np.log(total(b, k)) for k in range(len(model.languages))])


def test_held_out_accuracy(model, sf_dir):
    import pandas as pd

    d = pd.read_parquet(f"{sf_dir.replace('sf0.001', 'sf0.01')}/documents.parquet")
    d = d[d.lang.notna() & d.text.fillna("").str.len().gt(150)]
    names, sure = model.label(d.text.tolist())
    assert (pd.Series(names).values == d.lang.values).mean() > 0.97
    assert min(sure) > 0.1 and max(sure) <= 1.0


def test_labels_of_awkward_rows(spark, model):
    df = spark.createDataFrame([(1, "The harbour opens at nine and the path is steep.", "q"), (2, None, None), (3, "", ""), (4, "123 !!", "x"), (5, LONG, "z")], "id long, text string, language string")
    got = {r["id"]: r["language"] for r in language.label_texts(df, "text", model).collect()}
    assert got == {1: "en", 2: None, 3: None, 4: None, 5: "ja"}


EN = "The harbour opens at nine and the path behind the temple is steep and quiet. "
FR = "Le sentier derrière le temple est calme et les visiteurs viennent au printemps pour voir les fleurs. "
JA = "港の裏手に回ると、霧浜の町と柚見の田畑を見下ろせます。"


def test_segments_of_mixed_texts(spark, model):
    rows = [(1, EN + FR), (2, JA + EN), (3, EN), (4, None), (5, "12 !"), (6, "Москва стоит на реке."), (7, EN + JA + FR)]
    df = spark.createDataFrame(rows, "id long, text string").withColumn("language", F.lit("x"))
    got = {r["id"]: r["language_segments"] for r in language.label_segments(df, "text", model).collect()}
    assert {k: [s["language"] for s in v] for k, v in got.items()} == {1: ["en", "fr"], 2: ["ja", "en"], 3: ["en"], 4: [], 5: [], 6: [], 7: ["en", "ja", "fr"]}
    # The borders are those that are known, give or take a word.
    assert abs(got[1][0]["end"] - len(EN)) <= 12 and abs(got[2][0]["end"] - len(JA)) <= 6
    assert all(v[0]["begin"] == 0 and all(a["end"] == b["begin"] for a, b in zip(v, v[1:])) for v in got.values() if v)
    assert min(s["confidence"] for v in got.values() for s in v) > 0.5


def test_scripts_of_no_known_language(spark, model):
    df = spark.createDataFrame([(1, "Москва стоит на реке."), (2, "هذا نص"), (3, EN)], "id long, text string").withColumn("_l", F.lit(1))
    out = language.label_texts(df, "text", model)
    assert {r["id"]: r["language"] for r in out.collect()} == {1: None, 2: None, 3: "en"} and "_l" in out.columns


def test_wrong_labels(spark, model):
    ja, en = "港の裏手に回ると、霧浜の町と柚見の田畑を見下ろせます。", "Behind the harbour you can look down on the fields of the town."
    pages = [("a", "ja_JP", ja, [ja, ja]), ("b", None, ja, [ja, en]), ("c", "fr", None, [en]), ("d", "und", None, ["Back to top"]), ("e", "en", None, None), ("c", "fr", None, [en])]
    df = spark.createDataFrame(pages, "spot_id string, language string, description string, body_paragraphs array<string>").withColumn("slot", F.lit(1))
    got = {(r["record_key"], r["slot"], r["lang"]) for r in language.wrong_page_labels(df, "spot_id", "language", "description", "body_paragraphs", model).collect()}
    assert got == {("b", "language", "ja"), ("b", "1", "en"), ("c", "language", "en")}
    maps = spark.createDataFrame([("q", {"ja": ja, "en": ja, "xx": en, "de": ""}), ("r", None)], "qid string, descriptions map<string,string>")
    got = {(r["record_key"], r["slot"], r["lang"]) for r in language.wrong_map_keys(maps, "qid", "descriptions", model).collect()}
    assert got == {("q", "en", "ja"), ("q", "xx", "en")}


# Leaks --------------------------------------------------------------------------------------------

ITEM = "List three reasons why oyster stew cannot be carried from Shin-tomoshino to Kami-wakamine 70 hours after 9:14. How many tickets does a family of 3 from Ginbashi need when the tea house counts everyone over 7 centimetres as an adult?"
ITEM_JA = "石橋と2280円の通行料そして東琥里を通る迂回路に触れなければならない理由を説明しなさい。1234から3時間たつと漆の器を東榊谷から上鳴島へ運べなくなる理由を三つ挙げなさい。"


def test_wu_manber_against_find():
    r = random.Random(2)
    texts = ["".join(r.choice("ab") for _ in range(r.randrange(5, 400))) for _ in range(40)]
    windows = sorted({"".join(r.choice("ab") for _ in range(6)) for _ in range(20)})
    searcher = leakage.WuManber(windows, 6)
    import numpy as np

    chars = leakage.codes("".join(texts))
    ends = np.cumsum([len(t) for t in texts])
    lanes, starts, found = searcher.search(chars, ends - [len(t) for t in texts], ends)
    got = {(int(a), int(b - (ends[a] - len(texts[a]))), int(c)) for a, b, c in zip(lanes, starts, found, strict=True)}
    assert got == {(i, k, n) for i, t in enumerate(texts) for n, w in enumerate(windows) for k in range(len(t)) if t.startswith(w, k)}


def test_leaks(spark):
    half, third = ITEM[: len(ITEM) * 6 // 10], ITEM[: len(ITEM) // 3]
    docs = [
        (1, f"Before. {ITEM} After."),
        (2, f"Before. {half.upper()} after"),
        (3, f"Before. {third} after"),
        (4, ITEM.replace("70", "71").replace("Shin-tomoshino", "Oku-aoike").replace("Kami-wakamine", "Shin-ume").replace("Ginbashi", "Narutsu").replace("oyster stew", "plum wine")),
        (5, "".join(chr(ord(c) + 0xFEE0) if "!" <= c <= "~" else c for c in ITEM)),
        (6, "\n".join(ITEM.split(" "))),
        (7, ITEM[:60] + "[note] " + ITEM[60:]),
        (8, "前。" + ITEM_JA.replace("通行料", "通行行料").replace("理由を説明", "理由説明") + "後。"),
        (9, None),
        (10, ""),
        (11, LONG + ITEM_JA),
        (1, f"Before. {ITEM} After."),
        (None, ITEM),
    ]
    corpus = spark.createDataFrame(docs, "doc_id long, text string").withColumn("item_id", F.lit("x"))
    items = spark.createDataFrame([(91, ITEM), (92, ITEM_JA), (93, None), (94, "..."), (91, ITEM)], "item_id long, text string")
    got = {tuple(r) for r in leakage.find_leaks(corpus, items).collect()}
    assert got == {(d, 91) for d in (1, 2, 5, 6, 7, None)} | {(8, 92), (11, 92)}
    assert leakage.find_leaks(corpus, items.limit(0)).count() == 0
    assert leakage.find_leaks(corpus.limit(0), items).count() == 0


def stretch(text, passage):
    known = leakage.Passages.of([(0, passage)])
    normal = leakage.normal(text)
    return leakage.longest_stretch(leakage.codes(normal), known.pieces[0], len(known.texts[0]), list(range(0, len(normal), 50))) / len(known.texts[0])


def test_leaks_of_passages_that_share_their_wording(spark):
    body = "The ferry from the old harbour to the island of the lighthouse keeper leaves after the second bell, and whoever comes late must ask the {} to row them over before the tide turns at the northern pier."
    half = "Count the steps from the gate of the upper shrine to the bridge where the market is held in autumn."
    variants = [(i, body.format(w)) for i, w in enumerate(("miller", "baker", "smith", "priest", "teacher"))]
    ends = [(10 + i, half + tail) for i, tail in enumerate(("Name three colours of the lanterns seen by guests.", "Why did the carpenters refuse to work in winter?", "Which tea is poured for those who arrive by boat?", "How long does a letter take to reach the capital?"))]
    twice = "pass the red gate and turn left; " * 3
    items = spark.createDataFrame([*variants, *ends, (20, twice)], "item_id long, text string")
    docs = [(1, f"Before. {variants[0][1]} After."), (2, f"Before. {half} After."), (3, f"Before. {twice} After."), (4, "Count the steps from the gate."), (5, f"x {half[:30]}u{half[30:60]}{half[61:]} y")]
    corpus = spark.createDataFrame(docs, "doc_id long, text string")
    got = {tuple(r) for r in leakage.find_leaks(corpus, items).collect()}
    assert got == {(d, i) for d, t in docs for i, p in [*variants, *ends, (20, twice)] if stretch(t, p) >= 0.5}
    assert {(1, i) for i in range(5)} | {(2, 10), (2, 11), (2, 12), (2, 13), (3, 20), (5, 10), (5, 13)} <= got and not any(d == 4 for d, _ in got)


@pytest.mark.parametrize("block", [1, 3, 2000])
def test_leaks_do_not_depend_on_the_other_passages(spark, monkeypatch, block):
    """Five passages with one half in common, and a document that holds it, however many passages go in one pass."""
    half = "Count the steps from the gate of the upper shrine to the bridge where the market is held in autumn, "
    items = [(i, half + tail) for i, tail in enumerate(("and name the colours of all the lanterns there.", "and say why no carpenter works in the winter.", "or pour some tea for everyone who comes by boat.", "while a letter is on its way to the capital.", "before the bell of the temple rings at nine."))]
    monkeypatch.setattr(leakage, "PASSAGES_AT_ONCE", block)
    corpus = spark.createDataFrame([(1, f"Before. {half} After."), (2, half.replace("shrine", "shrin").replace("market", "marketx")), (3, "An autumn market.")], "doc_id long, text string")
    assert {tuple(r) for r in leakage.find_leaks(corpus, spark.createDataFrame(items, "item_id long, text string")).collect()} == {(d, i) for d in (1, 2) for i in range(5)}


def test_short_passages_are_found_whole(spark):
    items = spark.createDataFrame([(1, "ab"), (2, "stone bridge"), (3, "橋守の灯"), (4, "x")], "item_id long, text string")
    corpus = spark.createDataFrame([(1, "The cab."), (2, "An old Stone-Bridge!"), (3, "その橋守の灯は"), (4, "nothing"), (5, LONG + "stonebridge")], "doc_id long, text string")
    assert {tuple(r) for r in leakage.find_leaks(corpus, items).collect()} == {(1, 1), (2, 2), (3, 3), (5, 2)}


def test_equal_pieces_and_chains_against_brute_force():
    r = random.Random(3)
    for _ in range(60):
        passage, text = ("".join(r.choice("abc") for _ in range(r.randrange(4, 30))) for _ in range(2))
        want = set()
        for a in range(len(passage)):
            for b in range(len(text)):
                if a and b and passage[a - 1] == text[b - 1]:
                    continue
                n = 0
                while a + n < len(passage) and b + n < len(text) and passage[a + n] == text[b + n]:
                    n += 1
                if n >= leakage.LEAST_PIECE:
                    want.add((a, b, n))
        assert set(leakage.equal_pieces(leakage.codes(text), leakage.Passages.of([(0, passage)]).pieces[0])) == want
    assert leakage.longest_chain([(0, 0, 20), (22, 20, 30)]) == 52  # two characters left out
    assert leakage.longest_chain([(0, 0, 20), (20, 75, 30)]) == 50  # a note put in
    assert leakage.longest_chain([(0, 0, 20), (20, 85, 30)]) == 30  # too long a one
    assert leakage.longest_chain([(0, 0, 10), (12, 12, 10), (24, 24, 10), (36, 36, 10)]) == 22  # a name in every place


# Residue ------------------------------------------------------------------------------------------


@pytest.mark.parametrize(
    ("text", "rule"),
    [
        ("Name: {{spot_name}}\nHours: undefined\nFee: %s yen", "slot"),
        ("料金：（要記入）円", "slot"),
        ("奥${fee}と上桐峰を結ぶ旧道", "slot"),
        ("○○町の入場料", "slot"),
        ("Your description here.", "filler"),
        ("ダミー文章ダミー文章ダミー文章", "filler"),
        ("Lorem ipsum dolor sit amet.", "filler"),
        ("Sedvit isoreunt quevitpra aminul pra ver.", "filler"),
        ("blah blah blah blah", "filler"),
        ("The gate {{" + "x" * 300 + "}} is open.", "slot"),
        ("The inn has rooms. 404 Not Found", "error"),
        ("このページを表示する権限がありません。（f79208）", "error"),
        ("요청하신 페이지를 찾을 수 없습니다.", "error"),
        ("Erreur 502 : la page demandée est introuvable.", "error"),
        ("JavaScriptを有効にしてください。", "scripts"),
        ("您的浏览器已禁用脚本，无法显示内容。", "scripts"),
        ("Veuillez activer JavaScript pour afficher cette page.", "scripts"),
        ("笹森の公民館では毎月23日にプログラム教室が開かれ、JavaScriptを学べます。", None),
        ("The cafe called Not Found in Kami-togiriike serves 9 kinds of toast.", None),
        ("Room 404 of the old inn is kept empty because of a fire in 1928.", None),
        ("An error in the old map put the well 61 metres too far north.", None),
        ("Size XXXL happi coats are lent free of charge at Kamiike.", None),
        ("The sign writes the set of gates as {1, 2, 6}, counted from the harbour.", None),
        ("The border stayed undefined until 1903.", None),
        ("In 1920 about 5% of the guests came by boat, the other visitors on foot.", None),
        ("Wenn es regnet, kann man beim Torbau neben dem Bahnhof Buchweizentee probieren.", None),
    ],
)
def test_residue_rules(text, rule):
    assert residue._rules().rules([text])[0] == rule


def test_residue_of_awkward_rows(spark):
    rows = [(1, None, "s"), (2, "", "s"), (3, "  ", None), (4, LONG, "s"), (5, LONG + "{{x}}", None), (5, LONG + "{{x}}", None), (None, "404 Not Found", "s")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("rule", F.lit("x"))
    assert {r["doc_key"] for r in residue.find_residue(df).collect()} == {4, 5, None}  # 4: one sentence, said 20,000 times
    assert residue.find_residue(df.limit(0)).count() == 0
    assert {r["doc_id"] for r in residue.without_residue(df.filter("doc_id is not null")).collect()} == {1, 2, 3}


def test_recurring_weak_message(spark):
    rows = [(i, f"Ticket {i}: please try again tomorrow", f"s{i % 6}") for i in range(30)] + [(99, "You may try again at the next stall.", "s1")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    assert {r["doc_key"] for r in residue.find_residue(df).collect()} == set(range(30))


def examples(parsed):
    """Texts written by a parsed pattern, together using every alternative in it."""
    import re

    c = re._constants
    slots = []
    for op, what in parsed:
        if op is c.LITERAL:
            slots.append([chr(what)])
        elif op is c.IN:
            kind, first = what[0]
            slots.append(["z" if kind is c.NEGATE else chr(first) if kind is c.LITERAL else chr(first[0]) if kind is c.RANGE else {c.CATEGORY_SPACE: " ", c.CATEGORY_DIGIT: "1"}.get(first, "a")])
        elif op in (c.NOT_LITERAL, c.ANY):
            slots.append(["z"])
        elif op is c.SUBPATTERN:
            slots.append(examples(what[-1]))
        elif op is c.BRANCH:
            slots.append([e for branch in what[1] for e in examples(branch)])
        elif op in (c.MAX_REPEAT, c.MIN_REPEAT):
            slots.append(([""] if what[0] == 0 else []) + [e * max(1, what[0]) for e in examples(what[2])])
        elif op is c.ASSERT and what[0] > 0:
            slots.append(examples(what[1]))
    return [re.sub(" +", " ", "".join(s[i % len(s)] for s in slots)) for i in range(max(map(len, slots), default=1))]


def test_gate_of_the_residue_rules_loses_nothing():
    import re
    import warnings

    import regex

    rules = residue._rules()
    compiled = [(name, regex.compile(p)) for name, patterns in residue.STRONG.items() for p in patterns]
    ungated = lambda t: next((name for name, p in compiled if p.search(t)), "filler" if residue.mock_latin(t) else None)
    texts = ["Replace this text with your own.", "Ihr Text hier", "Hier steht Ihr Text.", "This site can't be reached", "Access restricted.", "Site em manutenção", "Site temporariamente indisponível", "Merci de réessayer plus tard.", "Der Server ist derzeit nicht erreichbar.", "(Insert name here)"]
    assert all(ungated(t) for t in texts)
    matched = 0
    for name, patterns in residue.STRONG.items():
        for p in patterns:
            with warnings.catch_warnings():
                warnings.simplefilter("ignore")
                parsed = re._parser.parse(re.sub(r"\\p\{\w+\}", "漢", re.sub(r"\(\?[im]+\)", "", p)))
            own = examples(parsed)
            own += [f"x\n{e} y" for e in own] + [f"漢{e}漢" for e in own]
            hits = [e for e in own if regex.search(p, e)]
            assert hits, p
            matched += len(hits)
            texts += own + [e.upper() for e in own]
    assert matched > 1000
    assert [(t, rules.rule(t)) for t in texts] == [(t, ungated(t)) for t in texts]


def test_recurring_messages_are_counted_over_all_documents(spark):
    weak = [(i, f"Ticket {i}: please try again tomorrow" + ("\n{{x}}" if i < 90 else ""), f"s{i % 6}") for i in range(100)]
    phrase = [(200 + i, f"Bad - gateway {i}!", f"s{i % 5}") for i in range(20)]  # no weak word, and no phrase in the raw text
    few = [(300 + i, f"The cup {i} failed.", f"s{i % 5}") for i in range(19)] + [(300, "The cup 0 failed.", "s0")]
    narrow = [(400 + i, f"The jug {i} failed.", f"s{i % 4}") for i in range(20)]
    times = [(500 + i, " ".join(f"{h}:{i:02d}" for h in range(8, 22)), f"s{i % 6}") for i in range(30)]
    df = spark.createDataFrame(weak + phrase + few + narrow + times, "doc_id long, text string, source string")
    got = {r["doc_key"]: r["rule"] for r in residue.find_residue(df).collect()}
    assert got == {i: "slot" if i < 90 else "recurring" for i in range(100)} | {200 + i: "recurring" for i in range(20)}
    ways = {r["doc_key"]: r["way"] for r in residue.find_residue(spark.createDataFrame([*weak, (900, "404 Not Found", "s"), (901, "mu " * 40, "s")], "doc_id long, text string, source string")).collect()}
    assert ways == {i: "recurring" for i in range(100)} | {900: "message", 901: "text"}


def test_gate_of_the_messages_loses_nothing(sf_dir):
    import pandas as pd

    rules = residue._rules()
    every = set(range(len(rules.patterns)))
    texts = [t for t in pd.read_parquet(f"{sf_dir}/documents.parquet").text if isinstance(t, str)]
    texts += ["Bad - gateway 5!", "Page 4 not/found", "Please try-again tomorrow", "Rien", "TEMPLATE", "bad 3 gateway", "こちらに 5 名前を入力"]
    for text in texts:
        want = {}
        for message in residue.messages(text):
            plain = residue.masked(message)
            strong = rules.broken(message, every)
            if strong or rules.weak.search(plain) or rules.broken(plain, every & rules.phrases):
                want[residue.signed_hash(plain)] = strong or want.get(residue.signed_hash(plain))
        near = rules.near(text)
        assert dict(rules.message_hashes(text, near - {residue.WEAKLY})) == want
