"""A small annotated book, counted by hand."""

import json

import pytest

from codexflow.operators import books, corpus, network, pattern
from codexflow.sources import annotated

HEAD = "paragraph_ID\tsentence_ID\ttoken_ID_within_sentence\ttoken_ID_within_document\tword\tlemma\tbyte_onset\tbyte_offset\tPOS_tag\tfine_POS_tag\tdependency_relation\tsyntactic_head_ID\tevent"
# Anna opened and closed the door . She was tired . " Come , Anna ! " said Tom .
TOKENS = [
    (0, 0, "Anna", "Anna", "PROPN", "nsubj", 1), (0, 0, "opened", "open", "VERB", "ROOT", 1), (0, 0, "and", "and", "CCONJ", "cc", 1),
    (0, 0, "closed", "close", "VERB", "conj", 1), (0, 0, "the", "the", "DET", "det", 5), (0, 0, "door", "door", "NOUN", "dobj", 3), (0, 0, ".", ".", "PUNCT", "punct", 1),
    (0, 1, "She", "she", "PRON", "nsubj", 8), (0, 1, "was", "be", "AUX", "ROOT", 8), (0, 1, "tired", "tired", "ADJ", "acomp", 8), (0, 1, ".", ".", "PUNCT", "punct", 8),
    (1, 2, '"', '"', "PUNCT", "punct", 12), (1, 2, "Come", "come", "VERB", "ccomp", 17), (1, 2, ",", ",", "PUNCT", "punct", 12), (1, 2, "Anna", "Anna", "PROPN", "npadvmod", 12),
    (1, 2, "!", "!", "PUNCT", "punct", 12), (1, 2, '"', '"', "PUNCT", "punct", 12), (1, 2, "said", "say", "VERB", "ROOT", 17), (1, 2, "Tom", "Tom", "PROPN", "nsubj", 17), (1, 2, ".", ".", "PUNCT", "punct", 99),
]
ENTITIES = [(1, 0, 0, "PROP", "PER", "Anna"), (1, 7, 7, "PRON", "PER", "She"), (1, 14, 14, "PROP", "PER", "Anna"), (2, 18, 18, "PROP", "PER", "Tom"), (3, 4, 5, "NOM", "PER_FAC", "the door"), (4, 18, 40, "PROP", "PER", "bad"), ("x", 1, 1, "NOM", "PER", "bad")]


def write(folder, name="tale", newline="\r\n", bom="﻿", tokens=TOKENS):
    folder.mkdir(parents=True)
    at, lines = 0, [HEAD]
    for n, (para, sent, word, lemma, pos, dep, head) in enumerate(tokens):
        lines.append("\t".join(map(str, (para, sent, 0, n, word, lemma, at, at + len(word), pos, pos, dep, head, "EVENT" if pos == "VERB" else "O"))))
        at += len(word) + 1
        if n == 2:
            lines.append("")
    (folder / f"{name}.tokens").write_text(bom + newline.join(lines) + newline, encoding="utf-8", newline="")
    (folder / f"{name}.entities").write_text("\n".join(["COREF\tstart_token\tend_token\tprop\tcat\ttext", *("\t".join(map(str, e)) for e in ENTITIES)]), encoding="utf-8")
    (folder / f"{name}.quotes").write_text("quote_start\tquote_end\tmention_start\tmention_end\tmention_phrase\tchar_id\tquote\n11\t16\t18\t18\tTom\t2\tCome\n", encoding="utf-8")
    (folder / f"{name}.supersense").write_text("start_token\tend_token\tsupersense_category\ttext\n5\t5\tnoun.artifact\tdoor\n4\t6\tnoun.other\tx\n", encoding="utf-8")
    (folder / f"{name}.book").write_text(json.dumps({"characters": [{"id": 2, "name": "Thomas", "g": {"argmax": "he/him/his"}}]}))


@pytest.fixture(scope="module")
def tale(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("library")
    write(root / "tale-20240101-000000", tokens=TOKENS[:3])
    write(root / "tale-20250101-000000")
    return annotated.load(spark, str(root))


def rows(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


def test_tokens(tale):
    got = rows(tale.token, "i", "para", "sent", "word", "head", "event")
    assert len(got) == len(TOKENS) and got[3] == (3, 0, 0, "closed", 1, True)
    assert got[19][4] == 19  # a head outside the book is the token itself
    assert tale.token.where("isword").count() == 13
    assert rows(tale.sizes, "n_tokens", "n_words", "n_sents", "n_paras") == [(20, 13, 3, 2)]


def test_mentions_quotes_and_senses(tale):
    assert rows(tale.mention, "mi", "coref", "cat") == [(0, 1, "PER"), (1, 1, "PER"), (2, 1, "PER"), (3, 2, "PER"), (4, 3, "FAC")]
    assert rows(tale.quote, "qi", "start", "end", "char") == [(0, 11, 16, 2)]
    assert rows(tale.supersense, "i", "ss") == [(4, "noun.other"), (5, "noun.artifact"), (6, "noun.other")]
    view = {r.i: r for r in books.token_view(tale).collect()}
    assert view[14].in_quote and view[14].speaker == 2 and view[14].ents == ["PER"] and not view[17].in_quote


def test_groups_and_relations(tale):
    assert rows(books.groups(tale), "coref", "type", "name", "mentions") == [(1, "PER", "Anna", 3), (2, "PER", "Thomas", 1), (3, "FAC", "the door", 1)]
    got = rows(books.relations(tale), "coref", "rel", "item")
    assert got == [(1, "agent", "close"), (1, "agent", "open"), (1, "mod", "tired"), (2, "agent", "say"), (3, "patient", "close")]
    assert rows(books.named_by(tale), "speaker", "coref", "n") == [(2, 1, 1)]
    pairs = rows(network.edges(books.company(tale)), "a", "b", "weight")
    assert pairs == [("e:tale:1", "e:tale:2", 1), ("e:tale:1", "e:tale:3", 1)]


def test_text_of_spans(spark, tale):
    spans = spark.createDataFrame([("tale", 1, 0, 6), ("tale", 2, 14, 14)], "book string, id long, s long, e long")
    assert rows(books.span_text(tale, spans), "id", "text") == [(1, "Anna opened and closed the door ."), (2, "Anna")]


def test_pins_and_damaged_books(spark, tmp_path):
    write(tmp_path / "tale-20240101-000000", tokens=TOKENS[:3])
    write(tmp_path / "tale-20250101-000000")
    assert annotated.load(spark, str(tmp_path), pins={"tale": "tale-20240101-000000"}).token.count() == 3
    bad = tmp_path / "bad-20250101-000000"
    write(bad, "bad")
    text = (bad / "bad.tokens").read_text()
    (bad / "bad.tokens").write_text(text.replace("lemma", "lemon", 1))
    with pytest.raises(Exception, match="has no column lemma"):
        annotated.load(spark, str(tmp_path), ["bad"]).token.collect()
    (bad / "bad.tokens").write_text(text.replace("\n0\t0\t", "\nzero\t0\t", 1).replace("\r\n0\t0\t", "\r\nzero\t0\t", 1))
    with pytest.raises(Exception, match="paragraph_ID is no number"):
        annotated.load(spark, str(tmp_path), ["bad"]).token.collect()
    with pytest.raises(annotated.SourceError):
        annotated.load(spark, str(tmp_path), ["missing"])


def test_reference_lists_and_lexicons(spark):
    lines = lambda *x: spark.createDataFrame([(v,) for v in x], "value string")
    assert rows(annotated.word_counts(lines("The 5", "of\t3", "the,2")), "item", "n") == [("of", 3), ("the", 7)]
    assert rows(annotated.word_counts(lines("1 10 the", "2 4 of")), "item", "n") == [("of", 4), ("the", 10)]
    assert rows(annotated.word_counts(lines("It isn't the dog's day")), "item", "n") == [("'s", 1), ("day", 1), ("dog", 1), ("is", 1), ("it", 1), ("n't", 1), ("the", 1)]
    assert rows(annotated.lexicon(lines("# c", "joy happy 1", "Sun happy", "rain sad 0")), "word", "category") == [("joy", "happy"), ("sun", "happy")]


def test_quotes_are_attributed(tale):
    got = books.quote_records(tale).collect()
    assert [(r.qi, r.words, r.verb, r.method, r.adverbs, r.vocatives) for r in got] == [(0, 2, "say", "subject", None, [1])]
    assert rows(books.conversations(tale), "qi", "conv") == [(0, 0)]


def test_verbs_near_quotes(spark, tmp_path):
    # " Go ! " he softly whispered . They ate . " No ! "
    tokens = [(0, 0, '"', '"', "PUNCT", "punct", 1), (0, 0, "Go", "go", "VERB", "ROOT", 1), (0, 0, "!", "!", "PUNCT", "punct", 1), (0, 0, '"', '"', "PUNCT", "punct", 1), (0, 0, "he", "he", "PRON", "nsubj", 6), (0, 0, "softly", "softly", "ADV", "advmod", 6), (0, 0, "whispered", "whisper", "VERB", "ROOT", 6), (0, 0, ".", ".", "PUNCT", "punct", 6), (0, 1, "They", "they", "PRON", "nsubj", 9), (0, 1, "ate", "eat", "VERB", "ROOT", 9), (0, 1, ".", ".", "PUNCT", "punct", 9), (1, 2, '"', '"', "PUNCT", "punct", 12), (1, 2, "No", "no", "INTJ", "ROOT", 12), (1, 2, "!", "!", "PUNCT", "punct", 12), (1, 2, '"', '"', "PUNCT", "punct", 12)]
    folder = tmp_path / "near-20250101-000000"
    write(folder, "near", tokens=tokens)
    (folder / "near.entities").write_text("COREF\tstart_token\tend_token\tprop\tcat\ttext\n1\t4\t4\tPRON\tPER\the\n")
    (folder / "near.quotes").write_text("quote_start\tquote_end\tchar_id\n0\t3\t1\n11\t14\tNone\n")
    found = annotated.load(spark, str(tmp_path))
    got = {r.qi: (r.verb, r.method, r.adverbs, r.char) for r in books.quote_records(found).collect()}
    assert got == {0: ("whisper", "after", ["softly"], 1), 1: (None, None, None, None)}
    assert rows(books.conversations(found, 3), "qi", "conv") == [(0, 0), (1, 1)]


def test_evidence(spark, tale):
    members = spark.createDataFrame([("tale", 1)], "book string, coref long")
    total, found = books.evidence(tale, books.relations(tale), members, "agent", "close")
    assert total == 1 and [r.text for r in found.collect()] == ["Anna opened and closed the door ."]


def test_chapters(spark, tmp_path):
    body = [("One", "NUM"), ("day", "NOUN"), ("came", "VERB"), (".", "PUNCT")]
    texts = [[("Chapter", "NOUN"), ("1", "NUM")], [("THE", "DET"), ("MOOR", "NOUN")], body, body, [("II", "NUM"), (".", "PUNCT")], body]
    tokens, n = [], 0
    for para, words in enumerate(texts):
        for word, pos in words:
            tokens.append((para, para, word, word.lower(), pos, "dep", n))
            n += 1
    folder = tmp_path / "ch-20250101-000000"
    write(folder, "ch", tokens=tokens)
    for kind in ("entities", "quotes", "supersense", "book"):
        if kind != "entities":
            (folder / f"ch.{kind}").unlink()
    found = annotated.load(spark, str(tmp_path))
    assert rows(books.chapters(found), "seg", "label", "s", "e") == [(0, "Chapter 1 THE MOOR", 0, 11), (1, "II .", 12, 17)]
    assert rows(books.headings(found), "para") == [(0,), (1,), (4,)]


def test_a_book_without_headings_is_one_segment(tale):
    assert rows(books.chapters(tale), "seg", "s", "e") == [(0, 0, 19)]


def test_scopes_units_and_filters(spark, tale):
    words = lambda **o: sorted(tuple(r.ws) for r in books.items(tale, **o).collect())
    told = ("anna", "opened", "and", "closed", "the", "door", "she", "was", "tired", "said", "tom")
    assert words(scope="narration") == [told] and words(scope="dialogue") == [("come", "anna")]
    assert words(scope="narration", runs=True) == [told[:9], told[9:]]  # the quote is a gap
    assert words(scope="narration", runs=True, within_sentence=True) == [told[:6], ("said", "tom"), told[6:9]]
    tom, anna = (spark.createDataFrame([("tale", n)], "book string, coref long") for n in (2, 1))
    assert words(scope="speech", speakers=tom) == [("come", "anna")] and words(scope="speech", speakers=anna) == []
    assert words(unit="lemma", pos=("VERB",)) == [("open", "close", "come", "say")]
    assert words(unit="word_pos", case=True, ents=("FAC",)) == [("the_DET", "door_NOUN")]
    assert words(unit="full", ents=("FAC",)) == [("the\tDET\tthe", "door\tNOUN\tdoor")] and words(unit="pos", tags=("NOUN",)) == [("NOUN",)]
    with pytest.raises(ValueError):
        books.items(tale, scope="speech")
    counted = {r.word: r.n for r in corpus.wordlist(books.items(tale, unit="lemma", scope="narration")).collect()}
    assert counted["open"] == 1 and sum(counted.values()) == 11


def test_patterns_over_annotations(tale):
    tokens = books.searchable(tale)
    find = lambda q: [(r.i, r.end) for r in pattern.search(tokens, q).orderBy("i").collect()]
    assert find('[char="Anna"]') == [(0, 1), (7, 8), (14, 15)] and find('[prop="PRON" & ent="PER"]') == [(7, 8)]
    assert find('[speaker="Thomas" & pos="VERB"]') == [(12, 13)] and find('[quote="in"]{6}') == [(11, 17)]
    assert find('[event="yes" & quote="out"]') == [(1, 2), (3, 4), (17, 18)] and find('[ss="noun.artifact"]') == [(5, 6)]
    assert find('[ent="FAC"]+ [pos="PUNCT"]') == [(4, 7)] and find('[char!="Anna" & pos="PROPN"]') == [(18, 19)]


def test_keys_forms_and_places(spark, tale):
    anna = spark.createDataFrame([("tale", 1)], "book string, coref long")
    assert rows(books.quote_keys(tale), "qi", "key") == [(0, "come , anna !#1")]
    assert rows(books.paragraph_keys(tale), "para", "key") == [(0, "anna opened and closed the door . she was tired .#1"), (1, "come , anna ! said tom .#1")]
    assert rows(books.forms(tale, anna), "prop", "form", "n") == [("PRON", "she", 1), ("PROP", "Anna", 2)]
    assert rows(books.presence(tale, anna, bins=4), "bin", "n") == [(0, 1), (1, 1), (2, 1)] and books.words_in(tale, anna) == 13
    assert rows(books.context_of(tale, "tale", 12, 13), "i", "hit") == [(i, i == 12) for i in range(11, 20)]
    assert rows(books.context_of(tale, "tale", 12, 13, longest=5, around=2), "i") == [(i,) for i in range(11, 15)]


def test_who_is_addressed(spark, tmp_path):
    # " Well , Ann , good fellow , the man , go to Ann , sir . "
    words = ['"', "Well", ",", "Ann", ",", "good", "fellow", ",", "the", "man", ",", "go", "to", "Bob", ",", "sir", ".", '"']
    folder = tmp_path / "voc-20250101-000000"
    write(folder, "voc", tokens=[(0, 0, w, w.lower(), "NOUN" if w.isalpha() else "PUNCT", "dep", 0) for w in words])
    mentions = [(1, 3, 3, "PROP", "PER"), (2, 5, 6, "NOM", "PER"), (3, 8, 9, "NOM", "PER"), (4, 13, 13, "PROP", "PER"), (5, 15, 15, "NOM", "PER"), (6, 3, 3, "PROP", "LOC")]
    (folder / "voc.entities").write_text("\n".join(["COREF\tstart_token\tend_token\tprop\tcat\ttext", *("\t".join(map(str, (*m, "x"))) for m in mentions)]))
    (folder / "voc.quotes").write_text("quote_start\tquote_end\tchar_id\n0\t17\tNone\n")
    # a name after a comma, a description between a comma and a full stop; no other description, nor a place
    assert rows(books.vocatives(annotated.load(spark, str(tmp_path))), "coref") == [(1,), (5,)]


def test_chapters_keep_a_gap(spark, tmp_path):
    body = [("some", "DET"), ("words", "NOUN"), ("here", "ADV"), (".", "PUNCT")]
    heads = lambda n: [("Chapter", "NOUN"), (str(n), "NUM")]
    texts = [heads(1), body, heads(2), body, body, heads(3), body, [("G.", "PROPN"), ("K.", "PROPN"), ("C.", "PROPN")]]
    tokens = []
    for para, words in enumerate(texts):
        tokens += [(para, para, word, word.lower(), pos, "dep", 0) for word, pos in words]
    folder = tmp_path / "gap-20250101-000000"
    write(folder, "gap", tokens=tokens)
    for kind in ("quotes", "supersense", "book"):
        (folder / f"gap.{kind}").unlink()
    found = annotated.load(spark, str(tmp_path))
    assert rows(books.headings(found), "para") == [(0,), (2,), (5,)]  # no signature
    assert rows(books.chapters(found), "label") == [("Chapter 1",), ("Chapter 2",), ("Chapter 3",)]
    # the second begins three words after the first, the third eight words after it
    assert rows(books.chapters(found, min_words=5), "seg", "label") == [(0, "Chapter 1"), (1, "Chapter 3")]
    assert len(rows(books.headings(found, numbered=False, caps=False, short=True), "para")) == 3
