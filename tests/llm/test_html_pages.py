"""Pages that stop words, markup or length alone would lose."""

import pytest

from reeltally.llm.html_text import main_text

MENU = '<ul><li><a href="/">Главная</a></li><li><a href="/n">Новости</a></li><li><a href="/a">О нас</a></li></ul>'
RU = ["Сегодня утром в город приехала большая делегация учёных, которые обсудили новые методы наблюдения.", "Они сообщили, что результаты работы будут опубликованы осенью этого года в нескольких журналах."]
ZH = ["今天早上一大批科学家来到这座城市，讨论了新的观测方法，并参观了天文台。", "他们表示，研究结果将于今年秋天在几份期刊上发表，供大家参考。"]


@pytest.mark.parametrize("texts", [RU, ZH])
def test_other_languages(texts):
    body = "".join(f"<div>{t}</div>" for t in texts)
    assert main_text(f"<html><body>{MENU}<div id='content'>{body}</div><footer>© 2020</footer></body></html>") == "\n\n".join(texts)
    assert main_text(f"<body><nav>{MENU}</nav><article>{body}<p><a href='x'>{texts[0]}</a></p></article></body>") == "\n\n".join([*texts, texts[0]])


def test_short_pages():
    assert main_text("<body><p>Hello world, the short page.</p></body>") == "Hello world, the short page."
    assert main_text("<body><nav><a>Home</a></nav><p>Hello there! Come in.</p></body>") == "Hello there! Come in."
    assert main_text("<body><nav>Home</nav><footer>Nothing else.</footer></body>") == ""
    assert main_text("") == ""


LONG = "The price of the share was as high as it had been in the year before, and that is what this is all about."


def test_names_inside_an_article():
    for name in ('class="share-price"', 'id="related-work"', 'class="comment-on-results"', 'class="lead no-menu-item x-ads-y"'):
        assert main_text(f"<article><p>{LONG}</p><div {name}><p>{LONG} Two.</p></div></article>") == f"{LONG}\n\n{LONG} Two.", name
    for name in ('class="share-bar"', 'id="comments"', 'class="comment-list"', 'class="ad-slot"', 'class="wide newsletter-signup"', 'class="related-posts"'):
        assert main_text(f"<article><p>{LONG}</p><div {name}><p>{LONG} Two.</p></div></article>") == LONG, name


def test_names_outside_an_article():
    for name in ('class="site-footer"', 'id="cookie-consent-2"', 'class="left-sidebar"'):
        assert main_text(f"<div><p>{LONG}</p></div><div {name}><p>{LONG} Two.</p></div>") == LONG, name
    assert main_text(f'<div><p>{LONG}</p></div><div class="my-related-topics"><p>{LONG} Two.</p></div>') == f"{LONG}\n\n{LONG} Two."


def test_a_paragraph_that_is_one_link():
    link = f"<p><a href='x'>{LONG}</a></p>"
    assert main_text(f"<article><p>{LONG}</p>{link}<p>{LONG}</p></article>") == "\n\n".join([LONG] * 3)
    menu = "".join(f"<li><a href='{i}'>Story number {i} of the day</a></li>" for i in range(5))
    assert main_text(f"<article><p>{LONG}</p><ul>{menu}</ul></article>") == LONG
