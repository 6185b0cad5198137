"""The parser on small sources."""

from stratograph.sources import parse

CS = """using System;
// class Fake { }
[ApiController]
public class ShopController : ControllerBase, IShop
{
    public string Name { get; set; }
    public int Run(int a) { if (a > 1 && a < 9) { return a > 5 ? 1 : 2; } foreach (var x in y) { } return 0; }
}
public interface IShop { }
class PlainService { string s = "if (x) { class Q { }"; }
"""
PY = '''import os
from shop.base import Base

class Cart(Base):
    """if in a docstring"""
    def add(self):
        if self.x and self.y:
            pass

def main():
    pass
'''


def test_brace_language():
    nodes, arcs = parse.parse_file("a/Shop.cs", "C#", CS)
    kinds = {n[2]: n[1] for n in nodes}
    assert kinds == {"Shop.cs": "File", "ShopController": "Controller", "IShop": "Interface", "PlainService": "Service"}
    assert ("a/Shop.cs::ShopController", "ControllerBase", "Inheritance") in arcs and ("a/Shop.cs::ShopController", "IShop", "Implementation") in arcs
    assert ("a/Shop.cs", "System", "Dependency") in arcs
    assert {n[2]: n[4] for n in nodes}["ShopController"] == 1 + 1 + 1 + 1 + 1 + 1 + 1  # if, foreach, &&, ?:, a method, a property


def test_python():
    nodes, arcs = parse.parse_file("shop/cart.py", "Python", PY)
    assert [(n[2], n[1]) for n in nodes] == [("cart.py", "File"), ("Cart", "Class"), ("main", "Function")]
    assert ("shop/cart.py::Cart", "Base", "Inheritance") in arcs and ("shop/cart.py", "shop.base", "Dependency") in arcs
    assert nodes[1][4] == 3


def test_graph_of_files(spark):
    files = spark.createDataFrame([("a/Shop.cs", CS), ("shop/cart.py", PY), ("shop/base.py", "class Base:\n    pass\n"), ("node_modules/x.js", "class X { }"), ("notes.txt", "class Y { }")], "path string, content string")
    g = parse.graph_of(files)
    ids = {r[0] for r in g.nodes.select("node_id").collect()}
    assert "shop/base.py::Base" in ids and not any("node_modules" in i or "notes" in i for i in ids)
    edges = {(r["src"], r["dst"], r["type"]) for r in g.edges.collect()}
    assert ("shop/cart.py::Cart", "shop/base.py::Base", "Inheritance") in edges
    assert ("shop/cart.py", "shop/base.py", "Dependency") in edges
    assert ("a/Shop.cs::ShopController", "a/Shop.cs::IShop", "Implementation") in edges


def test_files_of_a_batch_are_held_in_slices(spark):
    """All files of one batch are parsed, more than a task holds at a time; a null content is an empty file."""
    n = 2 * parse.FILES + 3
    files = spark.createDataFrame([(f"a/f{i}.py", None if i == 5 else "x\n" * (i % 4)) for i in range(n)], "path string, content string").coalesce(1)
    nodes, arcs = parse.parsed(files)
    assert {r["file_path"]: r["line_count"] for r in nodes.collect()} == {f"a/f{i}.py": 1 if i == 5 else i % 4 + 1 for i in range(n)} and arcs.count() == 0
