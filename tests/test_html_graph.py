from basaltine.sources import html_graph

PAGE = """<html><body>
<form id="f" action="/save" method="post"><p><input name="a" type="text" value="{{ user.name }}">
<select name="s"><option>1</option></select></p><button type="submit" onclick="go('/x')">ok</button></form>
<textarea name="t" form="f">${ note }</textarea><input name="lost">
<p>hello {{ who }} <% if (x) %><%= y.z %></p><a href="/next">n</a><div onload="init()"></div></body>"""


def test_pages_as_a_graph(spark):
    pages = spark.createDataFrame([("p.html", PAGE), ("none.html", None), ("bad.html", "<form <input name=q></b>")], "file string, content string")
    n = html_graph.nodes(pages).cache()
    rows = {(r.node): r for r in n.where("file = 'p.html'").collect()}
    kinds = [(r.type, r.name, r.value) for _, r in sorted(rows.items())]
    assert kinds == [
        ("FORM", "f", "/save"), ("INPUT", "a", "text"), ("TEMPLATE_VARIABLE", "user.name", None), ("SELECT", "s", None), ("BUTTON", None, "submit"), ("EVENT_HANDLER", "onclick", "go('/x')"),
        ("TEXTAREA", "t", None), ("TEMPLATE_VARIABLE", "note", None), ("INPUT", "lost", None), ("TEMPLATE_VARIABLE", "who", None), ("TEMPLATE_VARIABLE", "y.z", None), ("LINK", None, "/next"),
        ("ELEMENT", None, None), ("EVENT_HANDLER", "onload", "init()"),
    ]
    got = {(rows[r.src].name or rows[r.src].type, rows[r.dst].type, r.type) for r in html_graph.edges(n).where("file = 'p.html'").collect()}
    assert got == {
        ("a", "FORM", "INPUT_TO_FORM"), ("s", "FORM", "INPUT_TO_FORM"), ("BUTTON", "FORM", "INPUT_TO_FORM"), ("t", "FORM", "INPUT_TO_FORM"), ("user.name", "INPUT", "TEMPLATE_FLOW"),
        ("onclick", "BUTTON", "EVENT_TRIGGER"), ("note", "TEXTAREA", "TEMPLATE_FLOW"), ("onload", "ELEMENT", "EVENT_TRIGGER"),
    }
    assert n.where("file = 'none.html'").count() == 0
