import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tidewatch.llm import packing, residue, sentences, splitting, tokens

# -- problem 6 -------------------------------------------------------------------

ARTICLE = "The board met in spring and agreed on a plan for the harbour. Members asked for further figures before the autumn session. A vote is expected next year."
RESIDUE = [
    "Page not found – Some Institute\nTry the search box or return to the home page.",
    "You need to enable JavaScript to run this app.",
    "503 SERVICE UNAVAILABLE. THE SERVER IS DOWN FOR MAINTENANCE, REQUEST 490E940.FGZNZ0 WAS NOT COMPLETED.",
    "{{ page.title }}\n{{{ page.body }}}",
    "Dear {{first_name}}, the registry is open for comment.\n" + ARTICLE,
    ARTICLE + " Die Behörde zahlte [BETRAG] Kronen.",
    "[Insert headline here]\n[Author name], [Title]",
    ARTICLE + "\nLorem ipsum dolor sit amet consectetur adipiscing elit sed eiusmod tempor.",
    "undefined\n[object Object]\nNaN min, null",
    "Seite nicht gefunden\nDie angeforderte Seite xyz existiert nicht mehr.",
]
CLEAN = [
    ARTICLE,
    ARTICLE + " Designers still call their dummy paragraphs lorem ipsum, a habit the office wants to end.",
    ARTICLE + " The leaked form letter still greeted voters as “{{first_name}}”, which officials called a slip.",
    ARTICLE + " The schema writes every variable as ${name} and leaves filling it to the clerk.",
    ARTICLE + " Visitors to the portal saw a 404 notice for nine days, the audit found.",
    ARTICLE + " The cost rose to $4 million [sic], or 100% of the budget [12].",
    None, "", " \n",
]


def test_residue():
    index = residue.Index({"the": 900, "a": 900, "of": 900, "is": 500, "to": 800, "in": 800, "for": 500, "on": 500}, 1000)
    assert [t for t in RESIDUE if not residue.is_residue(t, index)] == []
    assert [t for t in CLEAN if residue.is_residue(t, index)] == []


def test_residue_operator(spark, rows):
    texts = [*RESIDUE, *CLEAN, "word " * 100_000]
    data = [(i, "A", t, "x") for i, t in enumerate(texts)] + [(0, "A", RESIDUE[0], "x")]
    df = spark.createDataFrame(data, "item_id bigint, institution string, extracted_text string, token string")
    assert rows(residue.found(df)) == sorted(((i,) for i in [0, *range(len(RESIDUE))]), key=repr)
    assert residue.found(df.where("false")).collect() == []


def test_residue_in_many_records_of_a_site(spark, rows):
    notices = [RESIDUE[0], RESIDUE[1], RESIDUE[6], RESIDUE[7].rpartition("\n")[2], RESIDUE[9]]
    articles = [f"{w} {ARTICLE} Report {w} of the board names all of the members who were there." for w in ("one", "two", "three", "four", "five", "six")]
    data = [(i, "A", t) for i, t in enumerate(n for n in notices for _ in range(8))]
    data += [(100 + i, "A", t + "\nPlease enable JavaScript to view this page.") for i, t in enumerate(articles)]
    df = spark.createDataFrame(data, "item_id bigint, institution string, extracted_text string")
    assert rows(residue.found(df)) == [(i,) for i in sorted(range(40), key=lambda i: repr((i,)))]


# -- problem 7 -------------------------------------------------------------------


@given(st.text(alphabet="ab. \n\n,é🤦‍", max_size=400), st.integers(5, 60), st.integers(0, 4))
@settings(max_examples=300, deadline=None)
def test_pieces(text, limit, overlap):
    spans = splitting.cut(text, limit, overlap)
    assert spans[0][0] == 0 and spans[-1][1] == len(text)
    assert all(b - a <= limit for a, b in spans)
    assert all(b[0] == a[1] - overlap for a, b in zip(spans, spans[1:]))
    assert "".join(text[a + (overlap if i else 0) : b] for i, (a, b) in enumerate(spans)) == text
    assert len(spans) == 1 or len(text) > limit


def test_pieces_at_boundaries_and_balanced():
    text = "\n\n".join("Sentence one here. And a second one." * 3 for _ in range(400))
    spans = splitting.cut(text, 12_000, 200)
    assert len(spans) == -(-(len(text) - 200) // 11_800) or len(spans) == 1 + -(-(len(text) - 200) // 11_800)
    assert all(text[:b].endswith("\n\n") for _, b in spans[:-1])
    sizes = [b - a for a, b in spans]
    assert min(sizes) > 0.6 * max(sizes)


def test_pieces_operator(spark, rows):
    data = [(1, None, 0), (2, "", 0), (3, "x" * 12_000, 0), (4, "x" * 12_001, 0), (4, "x" * 12_001, 0)]
    df = spark.createDataFrame(data, "item_id bigint, extracted_text string, piece_no int")
    assert rows(splitting.oversized(df)) == [(4,), (4,)]
    assert splitting.pieces(df).count() == 4 and splitting.pieces(df, whole=True).count() == 6
    assert splitting.oversized(df.where("false")).collect() == []


# -- problem 8 -------------------------------------------------------------------


@pytest.fixture(scope="module")
def encoder():
    path, pattern = tokens.default_vocabulary()
    with open(path, "rb") as f:
        return tokens.PrefixEncoder(f.read(), pattern)


@pytest.fixture(scope="module")
def reference():
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    return lambda text: t.encode(text, add_special_tokens=False).ids


SAMPLES = ["", " ", "Hello  world\n\n x", "<|endoftext|> it's 12.5%", "中文字符测试，没有空格。", "🤦🏼‍♂️ é é", "a" * 3000, "​⁠", "สวัสดี ครับ"]


def test_encoding(encoder, reference):
    for s in SAMPLES:
        assert encoder.encode(s) == reference(s)
    assert encoder.encode(None) == []


@given(st.text(max_size=60), st.lists(st.tuples(st.integers(0, 60), st.integers(0, 5), st.text(max_size=6)), max_size=4))
@settings(max_examples=200, deadline=None)
def test_appends_and_edits(encoder, reference, text, edits):
    kept = tokens.IncrementalEncoding(encoder, text)
    for a, n, new in edits:
        a = min(a, len(text))
        b = min(len(text), a + n)
        text = text[:a] + new + text[b:]
        kept.replace(a, b, new)
        assert kept.ids() == reference(text)
    kept.append(" end")
    assert kept.ids() == reference(text + " end")


def test_an_edit_is_local(encoder):
    kept = tokens.IncrementalEncoding(encoder, "some words in a row " * 2000)
    kept.worked = 0
    kept.replace(20_000, 20_001, "X")
    assert kept.worked < 100


def test_ids_operator(spark, reference):
    data = [(i, s, 0) for i, s in enumerate([*SAMPLES, None])] + [(0, "", 0)]
    got = tokens.token_ids(spark.createDataFrame(data, "doc_id bigint, text string, ids int")).collect()
    assert sorted((r.doc_id, list(r.ids)) for r in got) == sorted((i, reference(s or "")) for i, s, _ in data)
    assert tokens.token_ids(spark.createDataFrame([], "doc_id bigint, text string")).collect() == []


# -- problem 9 -------------------------------------------------------------------


def check_bins(placed, sizes, capacity):
    by_bin, by_key = {}, {}
    for k, part, n, b, at, cap in placed:
        assert cap >= at + n
        by_bin.setdefault(b, []).append((at, n))
        by_key[k] = by_key.get(k, 0) + n
    for spots in by_bin.values():
        full = sorted(s for s in spots if s[1])
        assert all(a + n <= b for (a, n), (b, _) in zip(full, full[1:]))
    assert by_key == {k: n or 0 for k, n in sizes}
    assert all(n <= capacity for _, _, n, *_ in placed)


@pytest.mark.parametrize("capacities", [{100: 1.0}, {100: 1.0, 40: 0.45}])
def test_packing(spark, capacities):
    rnd = random.Random(8)
    sizes = [(i, rnd.choice([None, 0, 7, 7, 7, 33, 51, 100, 101, 250, rnd.randrange(1, 99)])) for i in range(500)]
    got = [tuple(r) for r in packing.containers(spark.createDataFrame(sizes, "doc_id bigint, n_tokens int"), capacities=capacities).collect()]
    check_bins(got, sizes, 100)
    used, total = len({b for *_, b, _, _ in [(r[0], r[1], r[2], r[3], r[4], r[5]) for r in got if r[2]]}), sum(n or 0 for _, n in sizes)
    if len(capacities) == 1:
        assert total / (100 * used) > 0.97
    split = {k for k, part, *_ in got if part}
    assert split == {k for k, n in sizes if n and n > 100}


def test_packing_equals_best_fit():
    rnd = random.Random(9)
    sizes = [rnd.randrange(1, 60) for _ in range(300)]
    rooms = []
    for s in sorted(sizes, reverse=True):  # plain best fit decreasing
        fit = [r for r in rooms if r >= s]
        r = min(fit) if fit else 60
        if fit:
            rooms.remove(r)
        rooms.append(r - s)
    histogram = [(s, sizes.count(s)) for s in set(sizes)]
    _, runs, cost = packing.pack(histogram, {60: 1.0})
    assert cost <= len(rooms) * 1.02


def test_packing_of_nothing(spark):
    empty = spark.createDataFrame([], "doc_id bigint, n_tokens int")
    assert packing.containers(empty).collect() == []
    one = packing.containers(spark.createDataFrame([(1, 0)], "doc_id bigint, n_tokens int")).collect()
    assert [(r.doc_id, r.bin_id, r.n_tokens) for r in one] == [(1, 0, 0)]


# -- problem 10 ------------------------------------------------------------------


@pytest.mark.parametrize(
    "text, units",
    [
        ("One. Two? Three!", ["One.", "Two?", "Three!"]),
        ("Dr. Smith met J. K. Morva at 5.30 p.m. on Tues. in Room 2. He left.", ["Dr. Smith met J. K. Morva at 5.30 p.m. on Tues. in Room 2.", "He left."]),
        ("It was built in the U.S. Quen bought the rest.", ["It was built in the U.S.", "Quen bought the rest."]),
        ("They found rust, mould, etc. Repairs began.", ["They found rust, mould, etc.", "Repairs began."]),
        ("“Will it hold?” asked Vas. “No.” That was all.", ["“Will it hold?” asked Vas.", "“No.”", "That was all."]),
        ("The note reads, “They left. We stayed.” and bears no date.", ["The note reads, “They left. We stayed.” and bears no date."]),
        ("Nobody expected that... Sevka least of all.", ["Nobody expected that... Sevka least of all."]),
        ("Nach Art. 3 Abs. 2 gilt dies, vgl. Nr. 28. Am 3. Oktober kam er.", ["Nach Art. 3 Abs. 2 gilt dies, vgl. Nr. 28.", "Am 3. Oktober kam er."]),
        ("« Il en manque trop. » M. Istve n’a rien dit.", ["« Il en manque trop. »", "M. Istve n’a rien dit."]),
        ("«Es un deseo». La Sra. Yar no habló.", ["«Es un deseo».", "La Sra. Yar no habló."]),
        ("費用は14.1％増えた（図2.4参照）。「港は満杯だ。」と述べた。次。", ["費用は14.1％増えた（図2.4参照）。", "「港は満杯だ。」と述べた。", "次。"]),
        ("लागत 6.5 बढ़ी। कौन करेगा? सब।", ["लागत 6.5 बढ़ी।", "कौन करेगा?", "सब।"]),
        ("من سيدفع الثمن؟ لجنة المعادن طلبت. وزارة ردت.", ["من سيدفع الثمن؟", "لجنة المعادن طلبت.", "وزارة ردت."]),
        ("กรมรายงานเหตุการณ์ 800 ครั้งตามชายแดน คณะกรรมการเลื่อน", ["กรมรายงานเหตุการณ์ 800 ครั้งตามชายแดน", "คณะกรรมการเลื่อน"]),
        ("Heading\n \nText wraps\nhere. And on.\n- one. two\n- three", ["Heading", "Text wraps\nhere.", "And on.", "- one. two", "- three"]),
        ("1. First\n2. Second. Still second", ["1. First", "2. Second. Still second"]),
        ("Lost.Space here usw.Die Katze.", ["Lost.", "Space here usw.", "Die Katze."]),
        ("  \t\n ", []),
        ("", []),
        (None, []),
        ("no end \n\n", ["no end"]),
    ],
)
def test_sentences(text, units):
    words = lambda s: frozenset(s.split())
    corpus = sentences.Corpus(
        words("he repairs that space die the la and they"), words("e.g bzw tues b r uu"), words("p.m u.s usw"), words("dr mr k j m st sra"), words("art abs nr no fig"), words("oktober"), words("vgl ee")
    )
    begin, found = 0, []
    for end in sentences.ends(text, corpus):
        found.append(text[begin:end].strip())
        begin = end
    assert found == units


def test_abbreviations_are_learnt(spark):
    rnd = random.Random(3)
    name = lambda: "".join(rnd.choice("aeioulmnrst") for _ in range(7)).capitalize()
    texts = [
        f"Then Qr. {name()} came at {n} x.m. to the gate. It was see Fgr. {n} on the wall. They left on 3. Mober and the gate shut. The rest, i.q. the wall, stood until 9 x.m. It fell."
        for n in range(2, 30)
    ]
    corpus = sentences.corpus_tables(spark.createDataFrame([(t,) for t in texts], "text string"))
    assert corpus.naming == {"qr"} and corpus.referring == {"fgr"} and corpus.closing == {"x.m"} and corpus.inner == {"i.q"} and corpus.ordinal == {"mober"}
    assert len(sentences.ends(texts[0], corpus)) == 5 and len(sentences.ends(texts[0])) > 5


def test_sentences_operator(spark, rows):
    data = [(1, None, 0), (2, " ", 0), (3, "A b. C d.", 0), (3, "A b. C d.", 0), (4, "Word and more. " * 20_000, 0)]
    df = spark.createDataFrame(data, "doc_id bigint, text string, word int")
    got = rows(sentences.sentence_ends(df))
    assert got[:4] == [(3, 4), (3, 4), (3, 9), (3, 9)] and len(got) == 4 + 20_000
    assert sentences.sentence_ends(df.where("false")).collect() == []


def test_several_lengths_cost_no_more_than_one():
    rnd = random.Random(10)
    histogram = [(s, rnd.randrange(1, 40)) for s in rnd.sample(range(1, 2049), 400)]
    one = packing.pack(histogram, {2048: packing.LENGTHS[2048]})[2]
    slots, runs, cost = packing.pack(histogram, packing.LENGTHS)
    assert cost <= one
    few = [(700, 1), (2000, 3), (900, 4)]
    assert packing.pack(few, packing.LENGTHS)[2] < packing.pack(few, {2048: packing.LENGTHS[2048]})[2]
    assert len({c for _, _, c in packing.pack(few, packing.LENGTHS)[1]}) > 1
    assert sum(stop - rank for _, rank, stop, *_ in packing._sized(slots, runs)) == sum(n for _, n in histogram)
    many = {c: c + 16.0 for c in range(128, 2049, 128)}
    assert packing.pack(histogram, many)[2] <= one
