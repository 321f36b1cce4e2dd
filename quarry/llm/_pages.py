"""Hand-made labelled pages that the weights of ``html_text`` are learned from.

A template writes ``{n}`` for n words, ``*n(...)`` for a part that stands n times, and ``[[`` and ``]]``
around main text. What lies between two main parts of a template is an inset: a piece of the article's
element that is no text of the article.
"""

from __future__ import annotations

import re

#: News, blogs, documentation, wikis, shops and forums, as common templates lay them out.
TEMPLATES = (
    # a news site with semantic tags, an advert and a newsletter box inside the article
    """<html><body class="single news"><header class="site-header"><div class="logo">{2}</div><form class="search" role="search">{1}</form></header>
    <nav class="main-nav"><ul>*7(<li><a>{1}</a></li>)</ul></nav><div class="ad leaderboard">{9}</div>
    <main><article><header>[[<h1>{8}</h1><p class="lead">{20}</p>]]</header><div class="ad">{7}</div>[[*4(<p>{45} <a>{2}</a> {12}</p>)<blockquote>{14}</blockquote>]]
    <aside class="newsletter"><form>{12}</form></aside>[[*3(<p>{38}</p>)<ul>*3(<li>{7}</li>)</ul>]]<div class="share"><a>{1}</a><a>{1}</a></div><footer>{5}</footer></article></main>
    <aside class="sidebar"><h3>{2}</h3><ul>*5(<li><a>{8}</a></li>)</ul></aside><footer class="site-footer"><p>{14}</p><ul>*4(<li><a>{2}</a></li>)</ul></footer></body></html>""",
    # a blog by class names, with comments
    """<html><body class="post-template"><div id="page"><div id="masthead" class="header"><a>{3}</a></div><div class="menu"><ul>*5(<li><a>{1}</a></li>)</ul></div>
    <div id="content"><div class="post hentry">[[<h1 class="entry-title">{6}</h1><div class="post-meta">{5}</div><div class="entry-content">*5(<p>{50}</p>)<p><b>{3}</b> <i>{9}</i> <em>{4}</em></p>]]
    <div class="sharedaddy sharing"><a>{1}</a><a>{1}</a></div></div></div><div id="comments" class="comments-area"><h3>{2}</h3><ol class="commentlist">*6(<li class="comment"><div class="comment-author">{2}</div><p>{40}</p><a class="reply">{1}</a></li>)</ol>
    <div id="respond"><form class="comment-form">{9}</form></div></div></div><div id="secondary" class="widget-area sidebar">*3(<div class="widget"><h4>{2}</h4><ul>*4(<li><a>{4}</a></li>)</ul></div>)</div>
    <div id="colophon" class="footer">{12}</div></div></body></html>""",
    # documentation with a contents list and code
    """<html><body><div class="topbar"><a>{2}</a><form>{1}</form></div><div class="container"><div class="docs-nav sidebar"><ul>*14(<li><a>{3}</a></li>)</ul></div>
    <div class="docs-content main">[[<h1>{4}</h1><p>{30}</p>]]<div class="toc"><ul>*4(<li><a>{3}</a></li>)</ul></div>[[<h2>{3}</h2><p>{25} <code>{1}</code> {9}</p><pre>{18}</pre>
    <table><tr><th>{1}</th><th>{1}</th></tr>*3(<tr><td>{2}</td><td>{8}</td></tr>)</table><h2>{2}</h2><p>{33}</p><ol>*4(<li>{9}</li>)</ol><dl><dt>{2}</dt><dd>{11}</dd></dl>]]<div class="pagination"><a>{2}</a><a>{2}</a></div></div></div><div class="footer legal">{10}</div></body></html>""",
    # a page of few marks: no names, no parts
    """<html><body>[[<h1>{5}</h1><p>{40}</p><p>{22} <b>{3}</b> <br> {12}</p><h2>{3}</h2><div>{30}</div><div><div>{18}</div></div><p>{28}</p>]]<hr><p><a>{1}</a> | <a>{1}</a></p></body></html>""",
    # tables and divs, a cookie notice and a banner, text without paragraphs
    """<html><body><div class="cookie-notice consent">{18} <a>{2}</a></div><div class="banner alert">{9}</div><div id="wrapper"><div id="nav" class="navbar navigation"><a>{1}</a><a>{1}</a><a>{1}</a></div>
    <div id="story" class="text">[[<h2>{7}</h2>{40}<br><br>{35}<br><br>{50}]]<div class="advert sponsored">{6}</div>[[{42}<br>{20}]]</div><div id="right" class="rail widget"><div class="promo promotion">{9}</div><div class="related recommended"><a>{5}</a><a>{5}</a></div></div></div>
    <div id="bottom" class="copyright">{8}</div></body></html>""",
    # a wiki
    """<html><body><div id="header">{3}</div><div id="siteNotice" class="notice">{11}</div><div id="content" role="main">[[<h1>{3}</h1>]]<div class="breadcrumb"><a>{1}</a> <a>{1}</a></div><div class="body">[[<p>{60} <sup>{1}</sup> {20} <a>{2}</a> {15} <a>{1}</a> {9}</p><h2>{2} <span>{1}</span></h2><p>{44}</p>
    <ul>*5(<li>{6} <a>{2}</a></li>)</ul><div><p>{20}</p></div><figure><figcaption>{9}</figcaption></figure><p>{30}</p>]]</div></div><div id="navigation" role="navigation"><ul>*9(<li><a>{2}</a></li>)</ul></div><div id="footer" role="contentinfo"><ul>*4(<li>{7}</li>)</ul></div></body></html>""",
    # an article among sections, with breadcrumbs, tags and related reading inside
    """<html><body><nav class="breadcrumbs"><a>{1}</a><a>{1}</a></nav><main id="main"><section class="article-body prose"><article class="story">[[<h1>{9}</h1><div class="byline author">{4}</div><section><p>{41}</p><p>{37}</p></section>]]<div class="related"><h4>{2}</h4><a>{7}</a><a>{6}</a></div>
    [[<section><h2>{4}</h2><p>{35} <strong>{2}</strong> {10}</p></section>]]<div class="tags"><a>{1}</a><a>{1}</a></div><nav class="pager"><a>{3}</a><a>{3}</a></nav></article></section></main><footer><div class="subscribe signup"><form>{11}</form></div><p>{9}</p></footer></body></html>""",
    # a discussion below a short text; most words are comments
    """<html><body><div class="nav"><a>{1}</a><a>{1}</a><a>{1}</a></div><div class="main"><div class="content">[[<h2>{6}</h2><p>{35}</p><p>{31}</p>]]</div><section class="discussion comments"><h3>{1}</h3>*9(<article class="comment"><header>{3}</header><p>{60}</p><footer><a>{1}</a></footer></article>)</section></div>
    <div class="login overlay popup modal"><form>{7}</form></div></body></html>""",
    # an unmarked column beside an article, and a skip link
    """<html><body><a class="skip-link">{3}</a><div><a>{1}</a> <a>{2}</a></div><div>{14}</div><article class="post">[[<h1>{5}</h1><p>{33}</p><p>{45}</p><div>{21}</div><p>{28}</p>]]<section id="respond" class="replies disqus"><p>{30}</p></section></article><div><p>{12}</p></div><div>{9}</div></body></html>""",
    # a shop's guide with a menu dialog, social links and a long list of links
    """<html><body><header><menu>*4(<li><a>{1}</a></li>)</menu><dialog>{8}</dialog></header><div class="toolbar social"><a>{1}</a><a>{1}</a></div><div class="layout"><div class="column"><div class="article text">[[<h1>{6}</h1><h3>{3}</h3><p>{29}</p><p>{36}</p>]]<div class="ads ad-slot">{5}</div><div class="cta subscribe">{8}</div>[[<h3>{3}</h3><p>{44}</p><p>{17}</p>]]</div></div>
    <aside><ul>*12(<li><a>{5}</a></li>)</ul></aside></div><footer class="gdpr cookies">{16}</footer></body></html>""",
    # only menus and notices: no main text
    """<html><body><header><a>{2}</a></header><nav><ul>*8(<li><a>{2}</a></li>)</ul></nav><div class="login"><form>{6}</form></div><div class="cookie-consent">{15}</div><footer>{10}</footer></body></html>""",
    # the same in plain words
    """<html><body><header>{3}</header><nav>{4}</nav><aside>{12}</aside><div class="menu">{4}</div><div class="sidebar">{9}</div><div class="ad">{8}</div><form>{5}</form><div class="footer">{7}</div><footer>{9}</footer></body></html>""",
    # titles in headers of their own, comments as plain articles
    """<html><body><header class="page-header">{3}</header><div class="post"><header class="entry-header">[[<h1>{2}</h1></header><p>{30}</p><p>{22}</p>]]</div><section id="comments">*4(<article><p>{45}</p></article>)</section><nav>{5}</nav></body></html>""",
    """<html><body><div class="header">{3}</div><article><div class="entry-header">[[<h2>{3}</h2></div><p>{36}</p><p>{28}</p>]]<div class="comments">*3(<div><p>{33}</p></div>)</div></article><aside>{14}</aside></body></html>""",
    # a long read whose element holds nearly all of the page
    """<html><body><div class="page"><div class="top">{3}</div><div class="inner">[[<h1>{7}</h1>*9(<p>{55}</p>)<blockquote><p>{20}</p></blockquote>*4(<p>{48}</p>)<ul>*4(<li>{12}</li>)</ul>]]</div><div class="bottom">{4}</div></div></body></html>""",
    # an essay with many links, nested plain elements and a titled head
    """<html><body><header><h2>{2}</h2></header><div class="site"><div class="article-header">[[<h1>{6}</h1><p>{5}</p></div><div class="article-content"><div><p>{20} <a>{3}</a> {14} <a>{2}</a> {9}</p></div><div><div><p>{31} <a>{4}</a></p></div></div>
    <h4>{3}</h4><p>{19} <a>{1}</a>, <a>{2}</a>, <a>{1}</a> {12} <a>{3}</a></p><ul>*4(<li><a>{3}</a> {11}</li>)</ul><h3>{4}</h3><section><p>{27}</p></section><div><span>{16}</span> {20}</div><p>{8} <a>{6}</a></p>]]</div></div><ul class="links">*8(<li><a>{3}</a></li>)</ul><footer>{6}</footer></body></html>""",
    # a letter in a table layout, links in the left cell
    """<html><body><table class="layout"><tr><td class="menu"><a>{1}</a><br><a>{2}</a><br><a>{1}</a></td><td class="content">[[<h1>{4}</h1><p>{30}</p><p>{41}</p><center>{6}</center><p>{25}</p>]]</td></tr></table><div class="legal footer"><a>{2}</a> {8}</div></body></html>""",
    # a main element without an article, a search form and an advertisement inside
    """<html><body><div class="masthead">{4}</div><div role="navigation"><a>{1}</a><a>{1}</a></div><main class="content">[[<h1>{6}</h1><p>{32}</p>]]<form class="search">{3}</form>[[<p>{27}</p>]]<div class="advertisement advertising sponsor">{9}</div>[[<p>{46}</p><p>{12} <u>{2}</u> <small>{5}</small></p>]]<div class="comments"><div class="comment"><p>{33}</p></div><div class="comment"><p>{21}</p></div></div></main>
    <div class="sidebar"><div class="widget subscription">{9}</div></div><div class="footer">{11}</div></body></html>""",
)


def expand(template: str) -> str:
    page = template
    while (m := re.search(r"\*(\d+)\(([^()]*)\)", page)) is not None:
        page = page[: m.start()] + m[2] * int(m[1]) + page[m.end() :]
    page = re.sub(r"\{(\d+)\}", lambda m: " ".join(["word"] * int(m[1])), page)
    return page.replace("[[", "<!--main-->").replace("]]", "<!--/main-->")


def labelled_pages() -> list[str]:
    """Pages whose main text lies between <!--main--> and <!--/main-->."""
    return [expand(t) for t in TEMPLATES]
