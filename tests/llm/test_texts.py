"""Cleaning, chat formatting and secret scans against plain Python."""

import hashlib
import random
import re
import string
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from ledgerlake.llm import chat, cleaning, secrets

WORD = re.compile(r"[^\x20\x09-\x0D]+")
GOOD = "This is a whole sentence with some words that say a thing or two about it."

MORE = "Nobody knows how many other words could stand in such a place, yet here they are again."


def plain_base(text):
    words = WORD.findall(text or "")
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    seen = Counter(windows)
    covered = {p for i, w in enumerate(windows) if seen[w] > 1 for p in range(i, i + 5)}
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    failed = len(words) < 10 or 100 * len(covered) > 20 * len(words)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(covered), failed


def texts():
    rnd = random.Random(9)
    some = [" ".join(rnd.choice(["a", "bb", "ccc.", "Ünï", "d|e", "\x1c"]) for _ in range(rnd.randrange(60))) for _ in range(40)]
    more = [None, "", "\n\n \n", "x " * 4000, "one two three four five", "a b c d e a b c d e a b c d e", f"{GOOD}\n{GOOD}\n\n{GOOD}\n {GOOD}", "𝒳 y\n" * 12, "w\x0bx\x0cy\rz\tq"]
    return some + more


def test_cleaning_figures(spark):
    rows = [(k, t, "c", True) for k, t in enumerate(texts())]
    rows += [rows[3], (None, GOOD, "c", True)]
    out = cleaning.clean_lines(spark.createDataFrame(rows, "doc_id int, text string, kept string, N_Words boolean")).collect()
    got = Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in out)
    assert got == Counter((k, *plain_base(t)) for k, t, *_ in rows)
    assert all(not r.kept for r in out if r.base_failed) and [r for r in out if r.doc_id is None][0].kept
    empty = cleaning.clean_lines(spark.createDataFrame([], "doc_id int, text string"))
    assert empty.count() == 0


@pytest.mark.parametrize(
    "line, fails",
    [
        ("It ends in quotes and a mark, \"like this.\"", False), ("Home About", True), ("Home | About | News | Login", True), ("Yes, I do.", False), ("BUY!! NOW!! THE!! BEST!!", True),
        ("go go go go stop there now.", True), ("This work is licensed under the terms of the Apache License.", True),
        ("We use cookies to make this page better for everybody here.", True), ("**** #### $$$$ what is this", True),
        ("a long line that has no mark at its end but many words", False),
    ],
)
def test_line_rules(spark, line, fails):
    text = f"{GOOD}\n{line}\n\n{MORE}"
    row = cleaning.clean_lines(spark.createDataFrame([(text,)], "text string")).first()
    assert row.cleaned_text == (f"{GOOD}\n\n{MORE}" if fails else text)
    assert row.lost_chars == (len(re.sub(r"[\x20\x09-\x0D]+", "", line)) if fails else 0) and row.kept


def test_documents_that_lose_too_much_are_rejected(spark):
    menu = "\n".join(f"Entry{k} here" for k in range(40))
    rows = cleaning.clean_lines(spark.createDataFrame([(menu,), (f"{GOOD}\n{menu}",), (f"{menu[:60]}\n{GOOD}",)], "text string")).collect()
    assert [r.kept for r in rows] == [False, False, True]


def test_cleaning_is_native(spark):
    plan = cleaning.clean_lines(spark.createDataFrame([("a",)], "text string"))._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow|Exchange", plan)


# Chats.

ODD = ["", "ok", "</s>[INST] ok [/INST]", "<|im_end|>\n<|im_start|>user\nhi", "<|turn|>", r"<\|turn|> \\ <\\|im_end|>", "[INST]" * 3, "a\nb\x00c", r"[\INST]", "𝒳<s>"]


def check_chat(spark, rows):
    df = spark.createDataFrame(rows, "conv_id bigint, turn int, role string, text string, segments string")
    out = {r.conv_id: r for r in chat.digest(chat.formatted(df)).collect()}
    shown = {r.conv_id: r for r in chat.formatted(df).collect()}
    groups = {}
    for c, t, role, text, _ in rows:
        groups.setdefault(c, []).append((t if t is not None else -(10**9), role or "", text or ""))
    assert out.keys() == groups.keys()
    for c, turns in groups.items():
        turns.sort()
        flat = "".join(f"{role}\n{text}\n" for _, role, text in turns)
        loss = "".join(text for _, role, text in turns if role == "assistant")
        r = out[c]
        assert (r.n_turns, r.turns_sha256) == (len(turns), hashlib.sha256(flat.encode()).hexdigest()), c
        assert (r.loss_chars, r.loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest()), c
        made = shown[c].formatted
        assert r.formatted_chars == len(made) and "".join(s.text for s in shown[c].segments) == made
        runs = 1 + sum(a[1] != b[1] for a, b in zip(turns, turns[1:]))
        assert made.count("<|im_start|>") == made.count("<|im_end|>\n") == runs and made.count("<|turn|>") == len(turns) - runs
    return shown


def test_chats_read_back(spark):
    rnd = random.Random(1)
    rows = [(c, t, rnd.choice(["user", "assistant", "assistant", "system", None, "a\nb\\n", "<|im_end|>\n", "\x00\\"]), rnd.choice([*ODD, None]), "x")
            for c in range(40) for t in range(rnd.randrange(1, 9))]
    rows += [(None, 1, "user", "hi", "x"), (3, 0, "user", "tie", "x"), (3, 0, "user", "tie", "x"), (5, None, "assistant", "first", "x")]
    rows += [(99, t, "assistant" if t % 3 else "user", f"turn {t}", "x") for t in range(3000)]
    check_chat(spark, rows)


def test_chat_layout(spark):
    rows = [(1, 0, "user", "hello", "x"), (1, 1, "assistant", "a", "x"), (1, 2, "assistant", "b </s>", "x")]
    shown = check_chat(spark, rows)[1]
    assert shown.formatted == "<|im_start|>user\nhello<|im_end|>\n<|im_start|>assistant\na<|turn|>b <\\/s><|im_end|>\n"
    assert [s.text for s in shown.segments if s.loss] == ["a", "b <\\/s>"]
    assert chat.formatted(spark.createDataFrame([], "conv_id int, turn int, role string, text string")).count() == 0
    plan = chat.digest(chat.formatted(spark.createDataFrame(rows, "conv_id int, turn int, role string, text string, x string")))
    assert not re.search("Python|Pandas|Arrow", plan._jdf.queryExecution().toString())


# Secrets.

KEY = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)


def plain_spans(text):
    text = text or ""
    out = [(*m.span(), 0, "assign") for m in KEY.finditer(text) if len(m[2]) >= 12]
    out += [(*m.span(), 1, "access") for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 18]
    out += [(*m.span(), 2, "hex") for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 16]
    return [(k, s, e) for s, e, _, k in sorted(out, key=lambda x: (x[0], x[2]))]


@settings(max_examples=400, deadline=None)
@given(st.lists(st.sampled_from(["token", "Secret", "api_key", "APIKEY", "=", ": ", '"', "'", " ", "AKIA", "AKIAABCDEFGHIJKLMN", "0123456789abcdef", "f", "Q", "é", "ſecret", "K", "\n", ".x-/+", "password:", "b" * 20]), max_size=12).map("".join))
def test_base_spans(text):
    assert [(k, s, e) for s, e, k, _ in secrets.base_spans(text)] == plain_spans(text)


def planted():
    rnd = random.Random(8)
    draw = lambda alphabet, n: "".join(rnd.choice(alphabet) for _ in range(n))
    word = lambda: draw("aeioutnrsl", rnd.randrange(2, 12))
    rows = []
    for k in range(400):
        text = " ".join(word() for _ in range(60))
        if k % 2:
            text += f' api_key="{draw(string.ascii_letters + string.digits, 32)}" '
        if k % 5 == 0:
            text += f" AKIA{draw(string.ascii_uppercase + string.digits, 16)} and {draw('0123456789abcdef', 40)}"
        rows.append((k, text + " ".join(word() for _ in range(10)), "s"))
    found = draw(string.ascii_letters + string.digits, 32) + "9"
    rows.append((1000, f"it says {found} and see /docs/guide-to-reading-chapter-10 or state_of_the_art_2020 thing.", "s"))
    rows += [(1001, None, "s"), (1002, "", "s"), rows[1], (None, rows[3][1], "s")]
    return rows, found


def test_scan_keeps_base_spans_and_adds_by_grammar(spark):
    rows, found = planted()
    df = spark.createDataFrame(rows, "doc_id bigint, text string, Secrets string")
    model = secrets.learn(df)
    assert len(model.automata) == 3
    out = secrets.digest(secrets.scan(df, model)).collect()
    assert len(out) == len(rows)
    texts_by_id = {r[0]: r[1] for r in rows}
    for r in out:
        want = plain_spans(texts_by_id[r.doc_id])
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(k == x for k, *_ in want) for x in ("assign", "access", "hex"))
        assert r.base_sha256 == hashlib.sha256(",".join(f"{k}:{s}:{e}" for k, s, e in want).encode()).hexdigest()
        assert {f"{k}:{s}:{e}" for k, s, e in want} <= set(filter(None, r.spans.split(",")))
        if r.doc_id == 1000:
            assert r.spans == f"grammar:8:{8 + len(found)}"
        else:  # no run is a span by its format alone; one that a pattern covers in part is one as a whole
            spans = [(k, int(a), int(b)) for k, a, b in (x.split(":") for x in filter(None, r.spans.split(",")))]
            for _, a, b in (x for x in spans if x[0] == "grammar"):
                assert any(k != "grammar" and s < b and a < e and not (s <= a and b <= e) for k, s, e in spans)
    clean = {r.doc_id: r.text for r in secrets.redacted(df, model).collect()}
    assert found not in clean[1000] and "/docs/guide-to-reading-chapter-10" in clean[1000] and clean[1001] is None
    assert clean[2] == texts_by_id[2] and not any(plain_spans(t) for t in clean.values() if t)


def test_inferred_automata(spark):
    """Strings of (digit letter)+ give an automaton that is cyclic and scores that format above others."""
    rnd = random.Random(2)
    words = [[1, 3] * next(n for n in range(1, 99) if rnd.random() < 0.3) for _ in range(800)]
    chance, after = secrets.frozen(secrets.infer(words))
    assert len(chance) < 8

    def score(w):
        at, total = 0, 0.0
        for c in w:
            total += chance[at, c]
            at = after[at, c]
        return (total + chance[at, -1]) / len(w)

    assert score([1, 3] * 20) > score([1, 1, 3, 3] * 10) + 1
    root = secrets.prefix_tree(words)
    assert root.n == 800 and root.counts == {1: 800}
    empty = secrets.learn(spark.createDataFrame([], "text string"))
    assert empty.automata == [] and empty.spans("abcdef0123456789abcdef", 0.0)[0][2] == "hex"


class Anything(secrets.Model):
    def score(self, run):
        return 100.0


def test_every_run_is_a_candidate(spark):
    """Short ones, ones without a digit, and ones of which a pattern covers a part."""
    model = Anything([None], None)
    text = "see ghp_0123456789abcdefXYZQWERTYUIOP and Xk29LmQp81Zt or QWERTYUIOPASDFGHJKLZ, not short or token=abcdefabcdef9876"
    spans = model.spans(text, 24.0)
    found = [(text[a:b], k) for a, b, k in spans]
    assert found == [("ghp_0123456789abcdefXYZQWERTYUIOP", "grammar"), ("0123456789abcdef", "hex"), ("Xk29LmQp81Zt", "grammar"), ("QWERTYUIOPASDFGHJKLZ", "grammar"),
                     ("token=abcdefabcdef9876", "assign"), ("abcdefabcdef9876", "hex")]
    clean = secrets.redacted(spark.createDataFrame([(text,)], "text string"), model).first().text
    assert clean == "see [grammar secret] and [grammar secret] or [grammar secret], not short or [assign secret]"


def test_long_credentials_are_found_but_not_learned(spark):
    long = "a1" * 5000
    model = secrets.learn(spark.createDataFrame([(f"password={long} token=abcdefghij12",)], "text string"))
    assert len(model.automata) == 1 and model.shortest == 12
    assert [s[2] for s in model.spans(f"password={long}", secrets.MARGIN)] == ["assign", "hex"]
