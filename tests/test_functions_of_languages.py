"""Names and bodies of functions in languages with braces, by cases."""

import pytest

from siltstone.operators.parse import brace_functions, functions_of

C = r"""#include <stdio.h>
#define LOOP(x) for (;;) { \
  x; }
static int plain(int a, char *b) {
  if (a) { return 1; }
  char c = '{', *s = "}\"{";  /* } */ // }
  return 0;
}
int *pointer(void) { return 0; }
int (*handler(int signal))(int) { return 0; }
void (*table[2])(int);
struct point { int x, y; };
unsigned long
split_line(struct point *p)
{
  while (p) { p = 0; }
}
int values[] = { 1, 2 };
enum kind { A, B };
typedef struct { int a; } t;
__attribute__((noinline)) int marked(int x) { return x; }
int old(a, b) int a; { return a; }
"""
CPP = r"""namespace a { namespace b {
class Shape : public Base {
 public:
  Shape(int n) : n_(n), m_{2} { init(); }
  ~Shape() {}
  int area() const override { return n_; }
  bool operator==(const Shape &o) const { return true; }
  int operator()(int x) { return x; }
  template <typename T> T as() const noexcept { return T(); }
 private:
  int n_{0};
};
}}
int a::b::Shape::volume(std::vector<int> v) { auto f = [&](int x) { return x; }; return 0; }
std::string text() { return R"x({{{ " )" }x)x"; }
extern "C" { void exported(void) { } }
"""
JAVA = r"""package p;
@Annotated(value = {"a", "b"})
public class A<T> implements B {
  private int[] xs = {1, 2};
  static { setup(); }
  public A(int n) { this.n = n; }
  @Override @SuppressWarnings("x{") public <K extends Comparable<K>> Map<K, T> find(K k, List<? super T> l) throws IOException, E {
    Runnable r = () -> { run(); };
    new Thread(new Runnable() { public void run() { go(); } }).start();
    switch (k) { case 1: { break; } }
    return null;
  }
  interface I { default int one() { return 1; } int two(); }
  enum E { X { int f() { return 1; } }, Y; int f() { return 2; } }
  String s = "} // {"; char c = '}';
}
"""
JS = r"""import x from 'y';
function plain(a, b = {}) { return `}${`{${a}`}` + b; }
async function* stream() { yield 1; }
const arrow = (a) => { return a; };
const short = async a => { return a; };
let named = function inner() { return 1; };
exports.handler = async function (event) { if (event) { return {}; } };
module.exports = { key: function () { return 1; }, 'quoted': (x) => { return x; }, method(a) { return a; }, async other() { } };
class K extends L {
  constructor() { super(); }
  static get value() { return 1; }
  field = () => { return 2; };
  #hidden(a) { return a; }
}
const r = /[{}"]/g.test("}"), half = 4 / 2 / 1;
items.map(function (i) { return i; });
setTimeout(() => { tick(); }, 10);
if (r) { go(); }
for (const k of []) { go(); }
"""


@pytest.mark.parametrize(("language", "code", "want"), [
    ("c", C, [("plain", 4, 8), ("pointer", 9, 9), ("handler", 10, 10), ("split_line", 13, 17), ("marked", 21, 21)]),
    ("cpp", CPP, [("Shape", 4, 4), ("~Shape", 5, 5), ("area", 6, 6), ("operator==", 7, 7), ("operator()", 8, 8), ("as", 9, 9), ("volume", 14, 14), ("text", 15, 15), ("exported", 16, 16)]),
    ("java", JAVA, [("A", 6, 6), ("find", 7, 12), ("one", 13, 13), ("f", 14, 14), ("f", 14, 14)]),
    ("javascript", JS, [("plain", 2, 2), ("stream", 3, 3), ("arrow", 4, 4), ("short", 5, 5), ("inner", 6, 6), ("exports.handler", 7, 7), ("key", 8, 8), ('"', 8, 8), ("method", 8, 8), ("other", 8, 8),
                        ("constructor", 10, 10), ("value", 11, 11), ("field", 12, 12), ("#hidden", 13, 13), ("<anonymous>", 16, 16), ("<anonymous>", 17, 17)]),
    ("python", "class A:\n    async def f(self):\n        def g(): pass\n\ndef h(): pass", [("f", 2, 3), ("h", 5, 5)]),
])
def test_languages(language, code, want):
    assert functions_of(code, language) == want


@pytest.mark.parametrize("code", ["", "}}}", "f( {", "int f() {", "`${`", "/* never closed {", "'", "#define X \\", "x = {", "((((", "R\"x(", "a => {", "\x00{}"])
@pytest.mark.parametrize("language", ["c", "cpp", "java", "javascript", None])
def test_broken_code(language, code):
    assert isinstance(brace_functions(code * 3, language), list)


def test_deep_code_takes_no_stack():
    assert brace_functions("{" * 20_000 + "}" * 20_000, "c") == [] and brace_functions("int f() {" + "(" * 20_000 + ")" * 20_000 + "}", "c") == [("f", 1, 1)]
