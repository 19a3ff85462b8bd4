"""Valid and invalid code, written for each language from its grammar and not from any table."""

CONSTRUCTS = [("typescript","enum E { A = 1, B }\n"),("typescript","export enum Color {\n  Red = 'r',\n  Green = 'g',\n}\n"),("typescript","const enum E { A, B = A << 1 }\n"),("typescript","declare enum X { A }\n"),
("typescript","type M<T> = { readonly [K in keyof T]?: T[K] };\n"),("typescript","type M<T> = {\n  [K in keyof T]: T[K];\n};\n"),("typescript","type R<T> = { -readonly [P in keyof T]-?: T[P] }\n"),
("typescript","type C<T> = T extends string ? 'a' : never;\n"),("typescript","type C<T> = T extends (infer U)[] ? U : T extends Promise<infer V> ? V : T;\n"),
("typescript","class A<T> {\n  constructor(private readonly x: T) {}\n}\n"),("typescript","class A {\n  constructor(private a: number, public b = 2) {\n    super();\n  }\n}\n"),
("typescript","function f<T extends object, K extends keyof T>(a: T, k: K): T[K] { return a[k]; }\n"),("typescript","const x = <T,>(a: T): T => a;\n"),("typescript","function isS(x: unknown): x is string { return typeof x === 'string'; }\n"),("typescript","abstract class B { abstract f(): void; protected static n?: number = 1; }\n"),
("typescript","let t: [a: string, b?: number] = ['x'];\n"),("typescript","type F = new (...args: any[]) => object;\n"),("typescript","export type { A } from './a';\nimport type { B } from './b';\n"),
("typescript","const y = x as unknown as string[];\nlet z = y!.length;\n"),("typescript","declare module 'x' { export function f(a: number): void; }\n"),("typescript","type T1 = `a-${string}`;\n"),("typescript","interface I { [k: string]: number; (a: string): void; new (b: number): I; readonly q?: string }\n"),
("javascript","a: for (;;) { break a; }\n"),("javascript","outer:\nfor (const x of xs) {\n  for (const y of x) { continue outer; }\n}\n"),("javascript","const { a, b: { c = 1 }, ...rest } = o;\nconst [x, , y = 2] = z;\n"),("javascript","class A { #p = 1; static { init(); } get v() { return this.#p; } async *g() { yield* h(); } }\n"),("javascript","do { x++; } while (x < 3)\nif (a) b(); else c();\n"),("javascript","const f = function () { return 1; };\n(function () { g(); })();\n"),("javascript","export default function () { return 1; }\n"),("javascript","x ||= y ?? z?.[0]?.();\ndelete a.b;\nfor await (const q of r()) {}\n"),("javascript","switch (a) { case 1: case 2: f(); break; default: g() }\n"),("javascript","var re = /a[/]b/g.test(s) ? 1 : 2;\ntry { f() } catch { g() } finally { h() }\n"),("javascript","export * as ns from 'a';\nexport { x as default };\n"),("javascript","const o = { f() { }, get a() { return 1 }, async g() { }, *h() { }, [k]: 1, 'x': 2, 3: 4, ...r };\n"),("javascript","new Foo;\nvoid 0;\nlet a = b ? c : d ? e : f;\n"),
("rust","fn f<T>(t: T) -> u8 where T: Fn(u8) -> u8 { t(1) }\n"),("rust","impl<T> A for B<T>\nwhere\n    T: Fn(u8) -> u8 + Send + 'static,\n    for<'a> T: X<'a>,\n{\n    type Out = u8;\n    fn g(&self) -> Self::Out { 1 }\n}\n"),("rust","fn f() { let x = match y { Some(1..=3) | None => 1, Some(n) if n > 4 => { 2 } _ => 3, }; }\n"),("rust","fn f() { 'a: loop { break 'a; } let c = |x: u8, y| -> u8 { x + y }; let v = vec![1, 2]; if let Some(x) = y {} }\n"),("rust","macro_rules! m { ($x:expr) => { $x + 1 }; }\n"),("rust","pub trait T: A + B { const X: u8 = 1; fn f(&self) -> Box<dyn Fn(u8) -> u8>; }\n"),("rust","fn f() { let Some(x) = y else { return; }; let t = (1, 2).0; x?.y()?; }\n"),("rust","struct P(pub u8, u16);\nstruct U;\nenum E { A, B(u8), C { x: u8 }, D = 3 }\nstatic mut N: u8 = 1;\n"),("rust","async fn f() -> Result<(), E> { g().await?; Ok(()) }\nunsafe impl Send for X {}\nextern \"C\" { fn h(a: i32); }\n"),("rust","fn f() { let a = &mut b[1..]; let c = a as *const u8; *c = 1; let d = x::<u8>(); let e = S { a, ..b }; for i in (0..n).rev() {} while let Some(x) = s.pop() {} }\n"),
("go","package a\n\nfunc f(x interface{}) int {\n\tswitch v := x.(type) {\n\tcase int:\n\t\treturn v\n\tcase string, []byte:\n\t\treturn 1\n\tdefault:\n\t\treturn 0\n\t}\n}\n"),("go","package a\n\ntype N[T any] struct{ v T }\n\nfunc M[T, U any](a []T, f func(T) U) []U {\n\tvar out []U\n\tfor i := range a {\n\t\tout = append(out, f(a[i]))\n\t}\n\treturn out\n}\n"),("go","package a\n\nfunc f() {\n\tselect {\n\tcase x := <-c:\n\t\tg(x)\n\tcase d <- 1:\n\tdefault:\n\t}\n\tgo func() { h() }()\n\tdefer m.Unlock()\nloop:\n\tfor {\n\t\tbreak loop\n\t}\n}\n"),("go","package a\n\nconst (\n\tA = iota\n\tB\n)\n\nvar m = map[string]func(int) error{\n\t\"a\": func(x int) error { return nil },\n}\n\ntype I interface {\n\tF(a int) (b string, err error)\n\tio.Reader\n}\n"),("go","package a\n\nfunc f() (n int, err error) {\n\tif v, ok := m[k]; ok && v > 1 {\n\t\treturn\n\t} else if x := g(); x != nil {\n\t\tp := &T{A: 1, B: []int{1, 2}}\n\t\t*p = *q\n\t\tch <- x\n\t}\n\ta, b = b, a\n\ti++\n\treturn 1, nil\n}\n"),
("java","record P(int x) {\n    P {\n        if (x < 0) throw new IllegalArgumentException();\n    }\n}\n"),("java","class A { int f(Object o) { return switch (o) { default -> 0; }; } }\n"),("java","class A { int f(int o) { return switch (o) { case 1, 2 -> 3; case 4 -> { yield 5; } default -> throw new E(); }; } }\n"),("java","public sealed interface S permits A, B { }\n"),("java","class A { void f() { for (String s : xs) { g(s); } outer: while (true) { break outer; } List<String> l = new ArrayList<>(); Runnable r = () -> { h(); }; int[] a = new int[3]; var x = (String) y; l.forEach(System.out::println); } }\n"),("java","class A { void f(Object o) { if (o instanceof String s && s.length() > 1) { } try (var r = open()) { } catch (A | B e) { } finally { } do { } while (true); synchronized (this) { } assert x : \"y\"; } }\n"),("java","enum E { A(1) { int g() { return 1; } }, B; private int x; E(int x) { this.x = x; } E() { } }\n"),("java","@interface Ann { String value() default \"x\"; int[] n() default {}; }\n"),("java","class A<T extends Comparable<T> & B> { static <U> U f(U... u) throws E { return null; } static { x = 1; } Map<String, List<int[]>> m = Map.of(); }\n"),
("ruby","def m(a) = a + 1\n"),("ruby","class A\n  def self.x(y) = y * 2\n  def z = 1\n  def w\n    2\n  end\nend\n"),("ruby","x = if a then b else c end\ny = case z\n    when 1, 2 then 3\n    else 4\n    end\n"),("ruby","begin\n  f\nrescue A, B => e\n  g e\nensure\n  h\nend while x\n"),("ruby","a&.b\n[1, 2].map { |x| x + 1 }.select(&:odd?)\nh = { a: 1, 'b' => 2, **o }\nl = ->(x, y = 1) { x }\n"),("ruby","case v\nin { a: Integer => n } if n > 1\n  f\nin [x, *]\n  g\nend\n"),("ruby","unless a\n  b\nend\nuntil c do d end\nfor i in 1..3 do\n  p i\nend\n"),("ruby","private def x; 1; end\nmodule M; end\nclass B < Struct.new(:a); end\nputs <<~A\n  t #{x} (\nA\n"),
("c","int main(void) {\n    struct p a = { .x = 1, .y = { 2 } };\n    int (*f)(int) = g;\n    do { x--; } while (x > 0);\n    switch (x) { case 1: default: break; }\n    goto end;\nend:\n    return (int)a.x ? 1 : 2;\n}\n"),("c","typedef struct node {\n    struct node *next;\n    unsigned int flag : 1;\n} node_t;\nenum e { A = 1, B };\nstatic const char *names[] = { \"a\", \"b\" };\nextern int f(int, char *);\ntypedef int (*cb)(void *, size_t);\n"),("c","int f(a, b) int a; int b; { return a + b; }\n")]

REJECTED = [("javascript","function (a) { }\n"),("javascript","function () { return 1; }\nf();\n"),("javascript","let x = ;\n"),("javascript","if (a { b(); }\n"),("typescript","enum E { A = , B }\n"),("typescript","enum { A }\n"),("typescript","class A { constructor(private ) {} }\n"),("go","package a\nfunc f() { switch v := x.(type { } }\n"),("java","class A { int f() { return switch (o) { default -> ; }; } }\n"),("ruby","def m(a) = \nend\n"),("rust","fn f<T>() where T: Fn( -> u8 { }\n"),("java","class A { void f() { int x = 1 } }\n"),("go","package a\nfunc f() { x := }\n"),("c","int f( { return 1; }\n"),("ruby","class A\n def f\n end\n"),("typescript","type X = ;\n"),("rust","fn f() { let = 1; }\n"),("javascript","a b: c;\n")]
