"""URL patterns over modules that include each other, against a walk in plain Python."""

import pytest

from attestra.operators.python_facts import django_urls
from attestra.operators.url_graph import modules
from attestra.sources.python_ast import balanced, python_nodes

FILES = {
    "site/urls.py": 'urlpatterns = [path("", home), path("shop/", include("shop.urls")), include("blog.urls"), url(r"^old/(?P<pk>\\d+)/$", views.old, name="old"), path("gone/", include("missing.urls"))]',
    "site/shop/urls.py": 'urlpatterns = [path("items/<int:pk>/", views.item, name="item"), path("deep/", include(("shop.deep", "deep")))]',
    "site/shop/deep/__init__.py": 'urlpatterns = [path("<slug:s>/", V.as_view()), path("back/", include("shop.urls"))]\nother = [path("no/", x)]',
    "site/blog/urls.py": 'urlpatterns = [path("in/", include([path("<int:a>/", a), path("b/", include([path("c/", c)]))]))]',
    "site/empty.py": "urlpatterns = []", "site/broken.py": "urlpatterns = [",
}


@pytest.fixture(scope="module")
def found(spark):
    files = spark.createDataFrame([(f"/r/{p}", t) for p, t in FILES.items()] + [("/r/none.py", None)], "path string, text string")
    return django_urls(python_nodes(balanced(files)))


def test_includes(found):
    """Prefixes add up, the cycle of shop and its part ends, and what no file has stays a pattern."""
    shop = ["items/<int:pk>/", "deep/", "deep/<slug:s>/", "deep/back/"]
    deep = ["<slug:s>/", "back/", "back/items/<int:pk>/", "back/deep/"]
    blog = ["in/", "in/<int:a>/", "in/b/", "in/b/c/"]
    site = ["shop/", "^old/(?P<pk>{id})/$", "gone/", *["shop/" + x for x in shop], *blog]
    assert sorted(r.name for r in found.collect()) == sorted("GET " + x for x in site + shop + deep + blog)


def test_metadata(found):
    import json

    item = [r for r in found.collect() if r.name == "GET shop/items/<int:pk>/"][0]
    assert json.loads(item.metadata) == {"view_name": "item", "view_function": "views.item", "parameters": [{"name": "pk", "kind": "path"}]}
    assert [(p.name, p.kind) for p in item.parameters] == [("pk", "path")] and item.source_file == "<django_urls>"
    old = [r for r in found.collect() if "old" in r.name][0]
    assert json.loads(old.metadata)["route_regex"] == "^old/(?P<pk>\\d+)/$"


def test_modules(spark):
    paths = spark.createDataFrame([("a/b/c.py",), ("c.py",), ("x/b/__init__.py",), ("/abs/b/c.py",)], "path string")
    got = {r.module: r.path for r in modules(paths).collect()}
    assert got == {"c": "c.py", "b.c": "/abs/b/c.py", "a.b.c": "a/b/c.py", "abs.b.c": "/abs/b/c.py", "b": "x/b/__init__.py", "x.b": "x/b/__init__.py"}
