"""Operator 10: the html element may stand anywhere in a page."""

import time

from markerlake.llm import langid
from markerlake.llm.langid import UNTAGGED, visible


def declared(page):
    return langid.declared(UNTAGGED.sub(" ", page))


def test_declared_behind_long_preambles():
    assert declared("<!-- licence " + "x" * 9_000 + "-->\n<html lang='de'>") == "de"
    assert declared("\n" * 5_000 + "<!DOCTYPE html><html lang=fr-CA>") == "fr"
    assert declared("<html " + " ".join(f"data-a{i}='{i}'" for i in range(900)) + ' lang="es">') == "es"


def test_declared_only_by_tags_of_the_page():
    assert declared("<!-- <html lang='en'> --><html lang='de'>") == "de"
    assert declared("<!--><html lang='de'><!-- <html lang='en'> -->") == "de"
    assert declared("<!--[if !IE]><!--><html lang='de'><!--<![endif]-->") == "de"
    assert declared("<html><script>x = '<html lang=en>'</script><p lang=fr>") is None
    assert declared("<!-- <html lang='en'>") is None and declared("") is None
    assert declared("<html " * 200_000) is None
    assert declared('<html data-lang="de" lang="en">') == "en" and declared('<html data-lang="de" xml:lang="fr">') is None
    assert declared('<html class="a"lang="en">') == "en" and declared("<html\nlang=es>") == "es"


def test_what_never_ends_hides_the_rest_in_linear_time():
    assert visible(UNTAGGED.sub(" ", "a <script>b</script> c <p class='x'>d</p> 1 < 2 &amp; e <style> f")).split() == ["a", "c", "d", "1", "<", "2", "&", "e"]
    for x in ("<script ", "<!--", "<", "</", "<a ", "<html "):
        began = time.time()
        page = UNTAGGED.sub(" ", x * 200_000)
        visible(page)
        langid.declared(page)
        assert time.time() - began < 5
