"""Token counts against the library, text by text."""

from tokenizers import Tokenizer

from corvane.llm.tokens import Counter, TokenCount, count_tokens, op8_tokens, prove_whole_tokens, vocabulary_path


def library(texts):
    t = Tokenizer.from_file(vocabulary_path())
    return [len(t.encode(x or "", add_special_tokens=False).ids) for x in texts]


def test_documents(spark):
    d = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{d}/documents.parquet").orderBy("doc_id").collect()
    got = op8_tokens(spark, d).orderBy("doc_id").collect()
    assert [r.n_tokens for r in got] == library([r.text for r in docs])
    assert [r.n_bytes for r in got] == [len((r.text or "").encode()) for r in docs]
    assert all(r.over_limit == (r.n_tokens > 2048) for r in got)


TEXTS = [
    None, "", " \n\t\x0b\x0c\r", "Don't we'll I'M 's''s 'S x'sy", "<|endoftext|> a<|startoftext|>b <|x", "100% 3.14 1e5 ²³¼ x² ٣", "Ünïcödé ſtraße İstanbul ŉ Σίσυφος ΟΔΟΣ", "e\u0301 \u212b ﬁ e\u0301e", "a\u00a0b\u2003c\u200bd\u3000e\ufefff",
    "日本語テキスト 한국어 العربية हिन्दी", "😀👍🏽 x\U0001f600y", "a_b__c __init__ --- ... !?!", "x" * 3000, "the " * 5000, "\x00\x1f\x7f\x85 a\x1cb", "“quoted” – dash — … •", "ªº µ × ÷ ¿¡ €5 «a»", "A\u0301\u0300 \u1e9e ẞ ǅ ΐ", "'T 'RE 'Ve 'D 'LL", "\ud7ff\ue000 \u0378",
]


def test_edges(spark):
    df = spark.createDataFrame([(i, t, 1) for i, t in enumerate(TEXTS)] + [(None, "a b", 2)], "doc_id long, text string, n_tokens int")
    got = {r.id: r.n_tokens for r in count_tokens(df, vocabulary_path()).collect()}
    assert got == dict(enumerate(library(TEXTS))) | {None: 2}
    assert count_tokens(df.limit(0), vocabulary_path()).collect() == []


def test_each_character_of_the_safe_alphabet():
    with open(vocabulary_path(), encoding="utf-8") as f:
        text = f.read()
    whole = prove_whole_tokens(text)
    assert len(whole) > 20_000
    counter = Counter(text, whole, TokenCount().remembered)
    texts = [f"a{chr(c)}b {chr(c)} {chr(c)}{chr(c)}1'{chr(c)}" for c in [*range(1, 0x250), *range(0x2000, 0x2070), 0x20AC]]
    assert counter.count(texts) == library(texts)
    counter.most = 0  # forgets all it has merged
    assert counter.count(texts[:200]) == library(texts[:200])


def test_other_vocabularies_go_to_the_library():
    with open(vocabulary_path("byte_bpe_50k.json"), encoding="utf-8") as f:
        text = f.read()
    assert prove_whole_tokens(text) == []
    t = Tokenizer.from_str(text)
    assert Counter(text, [], 10).count(["Hello world", ""]) == [len(t.encode("Hello world", add_special_tokens=False).ids), 0]
