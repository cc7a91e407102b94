"""Single texts and pages that were once handled wrongly."""

from __future__ import annotations

import time

import pytest

from mirrorseq.llm import html, html_pages, pii, toxicity

KEY = bytes(range(32))


def in_script(text, zero):
    return "".join(chr(zero + int(c)) if c in "0123456789" else c for c in text)


@pytest.mark.parametrize("zero", [0xFF10, 0x0660, 0x0966])
@pytest.mark.parametrize("value", ["+415 555 0123 4", "4111 1111 1111 1111", "192.168.10.25", "2019-03-04", "123-45-6789", "DE89 3704 0044 0532 0130 00"])
def test_digits_of_other_scripts_are_protected(value, zero):
    plain, n = pii.pseudonymise(f"value: {value}", KEY)
    other, m = pii.pseudonymise(f"value: {in_script(value, zero)}", KEY)
    assert n == m == 1 and plain != f"value: {value}"
    assert other == in_script(plain, zero)  # linked across scripts


def test_mixed_digits_and_other_text_stay():
    text = "phone: +４１５ ５５５ ０１２３ ４, room ٣٤, ² and Ⅷ stay, mail a.b@example.org"
    new, n = pii.pseudonymise(text, KEY)
    assert n == 2 and "room ٣٤, ² and Ⅷ stay" in new and "５５５ ０１２３" not in new and len(new) == len(text)


@pytest.fixture(scope="module")
def model():
    by = {}
    for source in html_pages.labelled_pages():
        page = html.Page(source)
        y = page.labels()
        for i, e in enumerate(page.evidence()):
            if i:
                for f in (*e, f"parent {y[page.parent[i]]}"):
                    by[y[i], f] = by.get((y[i], f), 0) + 1
    return html.model_of(by)


@pytest.mark.parametrize("piece", ["<a ", "<a href='", '<a "', "<!", "<", "</", "<b>", "<p>", "</i>", "<script", "<li><b>", '<x ">"', "<td><i>", "<svg>", "<!-- ", "<dt><dd>", "&#"])
def test_broken_markup_takes_linear_time(model, piece):
    took = []
    for n in (20_000, 80_000):
        start = time.process_time()
        html.Page(piece * n)
        took.append(time.process_time() - start)
    assert took[1] < 4 * 3 * took[0] + 1.0


def test_text_outside_of_all_elements(model):
    text = "The harbour keeps two calendars. One is for the tides, and one for the market. " * 4
    assert html.main_text(text, model) == text.strip()
    assert html.main_text(f"<html><body>{text}</body></html>", model) == text.strip()
    assert html.main_text("", model) == "" and html.main_text(" \n ", model) == ""


def test_heading_of_an_article(model):
    body = "<p>Older people still answer in the first when asked in the second. Boats return late with nets and salt.</p>" * 3
    page = f"<html><body><header><h1>The Daily Paper</h1></header><nav><ul><li><a href=/>home</a></li></ul></nav><article><header><h1>Two calendars of a town</h1></header>{body}</article><footer>&copy; paper.example</footer></body></html>"
    got = html.main_text(page, model)
    assert got.startswith("Two calendars of a town\nOlder people") and "Daily" not in got and "paper.example" not in got


def test_comments_known_by_their_heading_alone(model):
    body = "<p>Older people still answer in the first when asked in the second. Boats return late with nets and salt.</p>" * 4
    talk = "".join(f"<div><b>mara{k}</b> <p>I saw the boats return last night, and nobody had counted them. It was late and the lamps were out.</p></div>" for k in range(3))
    page = f'<html><body><div id="k1"><h1>Two calendars</h1>{body}</div><div id="c12"><h3>3 replies</h3>{talk}</div></body></html>'
    got = html.main_text(page, model)
    assert got.count("Older people") == 4 and "I saw the boats" not in got


def test_a_target_is_a_person():
    grammar = toxicity.Grammar({})
    score = lambda t: max(grammar.clauses(t), default=0.0)
    assert score("you are an idiot") > score("this book is stupid") == score("those books are stupid")
    assert score("I hate you") > 0 and score("we despise those who hate him") > 0
    assert score("I hate Mondays") == 0 and score("you hate Mondays") == 0 and score("they hate, as we said, only you") == 0
    assert score("I do not hate you") < score("I hate you")
