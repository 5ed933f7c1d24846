"""Personal data: precision and recall of added spans on lines written by hand, many matches, odd inputs."""

import random
import time

from pyspark.sql import functions as F

from lodestream.llm import pii

# (kind, value in the line); the generator made none of these.
TRUE = [
    ("email", "write to bob [at] corp [dot] com when you can", "bob [at] corp [dot] com"), ("email", "Questions? Contact maria.lopez(at)hospital.org", "maria.lopez(at)hospital.org"), ("email", "send the form to office {at} school {dot} edu", "office {at} school {dot} edu"),
    ("email", "reach the editor: t.brown at journal dot net", "t.brown at journal dot net"), ("email", "Mail: j_k [AT] mailbox [DOT] de", "j_k [AT] mailbox [DOT] de"), ("email", "email peter <at> firm <dot> io for details", "peter <at> firm <dot> io"),
    ("email", "my e-mail is s.kim (at) lab (dot) org", "s.kim (at) lab (dot) org"), ("email", "cc hans.meier[at]stadt.de please", "hans.meier[at]stadt.de"), ("email", "schreib an lena (at) verein (dot) de", "lena (at) verein (dot) de"), ("email", "contact us: help at shopfront dot com", "help at shopfront dot com"),
    ("ip", "the server 2001:db8:85a3:0:0:8a2e:370:7334 is down", "2001:db8:85a3:0:0:8a2e:370:7334"), ("ip", "login from fe80::1ff:fe23:4567:890a failed", "fe80::1ff:fe23:4567:890a"), ("ip", "ping 2a02:26f7:d144::1 twice", "2a02:26f7:d144::1"),
    ("ip", "connect to host 2001:db8::ff00:42:8329 now", "2001:db8::ff00:42:8329"), ("ip", "ssh root to fd12:3456:789a:1::1", "fd12:3456:789a:1::1"), ("ip", "gateway address fe80:1234:abcd:5678:9abc:def0:1234:5678", "fe80:1234:abcd:5678:9abc:def0:1234:5678"),
    ("card", "paid by card 4111.1111.1111.1111 yesterday", "4111.1111.1111.1111"), ("card", "visa 4012.8888.8888.1881 expired", "4012.8888.8888.1881"), ("card", "credit card 5555/5555/5555/4444", "5555/5555/5555/4444"), ("card", "charge 3782.8224.6310.005 for it", "3782.8224.6310.005"), ("card", "my debit card: 6011.1111.1111.1117", "6011.1111.1111.1117"),
    ("phone", "please call 555-123-4567 today", "555-123-4567"), ("phone", "fax 555.123.4567", "555.123.4567"), ("phone", "Call me on (212) 555-0187 after six", "(212) 555-0187"), ("phone", "tel 030 12345678 or leave a note", "030 12345678"), ("phone", "mobile 0171 2345678", "0171 2345678"),
    ("phone", "phone 06 12 34 56 78 before noon", "06 12 34 56 78"), ("phone", "text 415 555 2671 to join", "415 555 2671"), ("phone", "the hotline is 800-555-0199", "800-555-0199"), ("phone", "Telefon: 089/4567890", "089/4567890"), ("phone", "dial 01-23-45-67-89 for help", "01-23-45-67-89"),
    ("phone", "Ring 0207 946 0958 and ask for Jo", "0207 946 0958"), ("phone", "my cell: 646.555.0143", "646.555.0143"), ("phone", "sms to 0176 98765432", "0176 98765432"), ("phone", "appelez le tel 01 45 67 89 10", "01 45 67 89 10"), ("phone", "contact number 312-555-0110", "312-555-0110"),
]
FALSE = [
    "we met at noon.Then we left", "look at page.html for more", "stay at home dot com was a thing of its day".replace(" dot com", ""), "arrived at dawn.We slept", "he laughed at once.It was late", "a talk at work.And then tea", "std::vector holds a::b", "Foo::Bar::baz calls it",
    "at 12:30:45:10 the light went out", "lap time 1:02:33:44", "mac 00:1A:2B:3C:4D:5E of the card reader".replace("card reader", "old box"), "build 10:20:30:40", "C::D and face::add are names", "ratio 1:2:3:4 of the mix",
    "part 1234.5678.9012.3456 is sold out", "serial 9999/8888/7777/6666", "version 2023.1001.2002.3003", "isbn 9780.1306.4024.123", "total 1000.2000.3000.4001", "tracking 4444.3333.2222.1111",
    "order 555-123-4567 has shipped", "invoice 212.555.0187 is due", "case 415-555-2671 was closed", "ref 020 12345678", "sku 0171 2345678 in stock", "batch 06 12 34 56 78", "model 800-555-0199 of last year", "ticket 312.555.0110", "price 12 34 56 78 90",
    "order 2024 12345678 price", "scores 10-20-30-40-50 in the end", "page 123 456 7890", "between 1990 and 2010-2011", "in 1999-2000 12345 people", "total 12 345678 items", "item 100-200-3000", "the years 2019-2020-2021", "measured 12.34.56.78.90 units", "serial (212) 555-0187", "part no 646.555.0143",
]


def spans(spark, lines):
    rows = spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string")
    return {r.doc_id: [(pii.KINDS[s.kind], lines[r.doc_id][s.start : s.end]) for s in r.spans if s not in r.base] for r in pii.find(rows).collect()}


def test_added_spans_on_lines_by_hand(spark):
    found = spans(spark, [line for _, line, _ in TRUE] + FALSE)
    right = sum((kind, value) in found[i] for i, (kind, _, value) in enumerate(TRUE))
    wrong = sum(len(v) for v in found.values()) - right
    print(f"precision {right / (right + wrong):.3f} recall {right / len(TRUE):.3f}")
    print([(t, found[i]) for i, t in enumerate(TRUE) if (t[0], t[2]) not in found[i]], [(FALSE[i - len(TRUE)], v) for i, v in found.items() if v and i >= len(TRUE)])
    assert right / len(TRUE) >= 0.9 and right / (right + wrong) >= 0.9


#: Frames of lines that no generated example has, for values of each kind and for things that look like them.
GOOD_FRAMES = {
    "email": ["Should you need help, drop a line to {v} before Friday.", "Our press office ({v}) answers all questions.", "RSVP: {v}", "The author's address is {v} since May", "forward it to {v}, she knows"],
    "ip": ["traffic from {v} was blocked last night", "Add {v} to the list of hosts that may connect.", "traceroute {v} gave nothing", "the router's address, {v}, had changed", "user logged in, peer {v}, port 22"],
    "card": ["She gave {v} as the number of her Visa.", "Please debit {v} every month", "MasterCard {v}, valid until 09/27", "we charged {v} twice by mistake", "Kreditkarte: {v}"],
    "phone": ["You can ring the office, {v}, after ten.", "Mobile number {v} (evenings only)", "Bitte Telefon {v} verwenden", "If no one is there, call {v} and leave a message.", "Fax and phone: {v}"],
}
BAD_FRAMES = ["order number {v} left the house", "Invoice {v} has not been paid", "its ISBN is {v}, second edition", "firmware version {v} mends it", "the total came to {v} in the end", "serial no. {v} on the back", "page {v} of the annex", "tracking code {v} says Tuesday"]


def _lines(seed):
    rnd = random.Random(seed)
    d = lambda n: "".join(rnd.choice("0123456789") for _ in range(n))
    hexa = lambda: f"{rnd.randrange(4096, 65535):x}"

    def card(groups, sep):
        body = rnd.choice("345") + d(sum(groups) - 2)
        for c in "0123456789":
            if sum(sum(divmod(int(x) * (2 - i % 2 and 1 + i % 2), 10)) if i % 2 else int(x) for i, x in enumerate(reversed(body + c))) % 10 == 0:
                body += c
                break
        out, at = [], 0
        for n in groups:
            out.append(body[at : at + n])
            at += n
        return sep.join(out)

    name, host, tld = (lambda: rnd.choice(["greta.w", "otto", "li_na", "p-kane", "desk", "y.sato"])), (lambda: rnd.choice(["harbour", "orchard", "lumen", "north-sea"])), (lambda: rnd.choice(["org", "eu", "net", "it"]))
    good = {
        "email": [lambda: f"{name()} [at] {host()} [dot] {tld()}", lambda: f"{name()}(at){host()}.{tld()}", lambda: f"{name()} at {host()} dot {tld()}", lambda: f"{name()} ät {host()}.{tld()}", lambda: f"{name()} arroba {host()} punto {tld()}", lambda: f"{name()}@{host()}[.]{tld()}"],
        "ip": [lambda: ":".join(hexa() for _ in range(8)), lambda: f"2001:db8::{hexa()}:{hexa()}", lambda: f"fe80::{hexa()}", lambda: f"::ffff:192.0.{rnd.randrange(256)}.{rnd.randrange(256)}", lambda: "[.]".join(str(rnd.randrange(256)) for _ in range(4)), lambda: "(.)".join(str(rnd.randrange(256)) for _ in range(4))],
        "card": [lambda: card([4, 4, 4, 4], "."), lambda: card([4, 4, 4, 4], "_"), lambda: card([4, 4, 4, 4], "/"), lambda: card([4, 4, 4, 4], " - "), lambda: card([4, 4, 4, 4], "  "), lambda: card([4, 6, 5], ".")],
        "phone": [lambda: f"{rnd.randrange(200, 999)}{d(7)}", lambda: f"0{rnd.randrange(20, 99)}{d(7)}", lambda: f"0049 {rnd.randrange(30, 99)} {d(6)} {d(2)}", lambda: f"(0){rnd.randrange(30, 99)}-{rnd.randrange(100000, 999999)}", lambda: f"{rnd.randrange(200, 999)} {rnd.randrange(2000000, 9999999)}",
                  lambda: f"({rnd.randrange(200, 999)}) {rnd.randrange(200, 999)}-{d(4)}", lambda: " ".join(["06", *(f"{rnd.randrange(10, 99)}" for _ in range(4))]), lambda: f"0{rnd.randrange(171, 179)}/{rnd.randrange(1000000, 9999999)}", lambda: f"{rnd.randrange(200, 999)}.{rnd.randrange(200, 999)}.{d(4)}"],
    }
    bad = [lambda: f"{rnd.randrange(200, 999)}{d(7)}", lambda: f"{rnd.randrange(200, 999)}-{rnd.randrange(200, 999)}-{d(4)}", lambda: f"{rnd.randrange(1, 9)}{d(8)}", lambda: ".".join(d(4) for _ in range(4)), lambda: "_".join("1" + d(3) for _ in range(4)), lambda: f"{rnd.randrange(10, 99)}:{d(2)}:{d(2)}:{d(2)}",
           lambda: f"{rnd.randrange(200, 999)} {rnd.randrange(2000000, 9999999)}", lambda: " ".join(f"{rnd.randrange(10, 99)}" for _ in range(5)), lambda: f"20{d(2)}-{d(5)}", lambda: f"({rnd.randrange(200, 999)}) {rnd.randrange(200, 999)}-{d(4)}"]
    true = [(k, f, v) for k, frames in GOOD_FRAMES.items() for f in frames for make in good[k] for _ in range(2) for v in [make()]]
    false = [f.format(v=make()) for f in BAD_FRAMES for make in bad for _ in range(3)]
    return [(k, f.format(v=v), v) for k, f, v in true], false


def test_held_out_lines(spark):
    """Measured on frames and values that no training form was made after; at least 200 lines of each sort."""
    true, false = _lines(11)
    assert len(true) >= 200 and len(false) >= 200
    found = spans(spark, [line for _, line, _ in true] + false)
    hit = [(k, v) in found[i] for i, (k, _, v) in enumerate(true)]
    wrong = sum(len(v) for v in found.values()) - sum(hit)
    per = {k: sum(h for h, t in zip(hit, true, strict=True) if t[0] == k) / sum(t[0] == k for t in true) for k in GOOD_FRAMES}
    print(f"held out: precision {sum(hit) / (sum(hit) + wrong):.3f} recall {sum(hit) / len(true):.3f}", {k: round(x, 2) for k, x in per.items()})
    print([t[1] for h, t in zip(hit, true, strict=True) if not h][:40], [(false[i - len(true)], v) for i, v in found.items() if v and i >= len(true)][:20], [(true[i], v) for i, v in found.items() if i < len(true) and len(v) > 1][:10])
    assert sum(hit) / len(true) >= 0.85 and sum(hit) / (sum(hit) + wrong) >= 0.95


def test_a_longer_number_around_a_base_span(spark):
    lines = ["appelez le 06.12.34.56.78 ce soir", "host ::ffff:192.0.2.1 is up"]
    rows = pii.find(spark.createDataFrame(list(enumerate(lines)), "doc_id int, text string")).orderBy("doc_id").collect()
    told = [[(pii.KINDS[s.kind], r.text[s.start : s.end]) for s in r.spans] for r in rows]
    assert told == [[("ip", "06.12.34.56"), ("phone", "06.12.34.56.78")], [("ip", "::ffff:192.0.2.1"), ("ip", "192.0.2.1")]]
    assert [r.text for r in pii.redact(spark.createDataFrame(list(enumerate(lines)), "doc_id int, text string")).orderBy("doc_id").collect()] == ["appelez le [IP] ce soir", "host [IP] is up"]


def test_many_matches_in_one_text(spark):
    text = "a1@b.co +12345678901 1.2.3.4 " * 20_000
    began = time.time()
    row = pii.find(spark.createDataFrame([(text,)], "text string")).select(F.size("base").alias("n"), F.element_at("base", -1).alias("last"), F.element_at("base", 20_000).alias("mail")).first()
    assert row.n == 60_000 and row.mail.end == 29 * 19_999 + 7 and row.last.start == 29 * 19_999 + 8
    assert time.time() - began < 60


def test_odd_tables_and_clashing_names(spark):
    rows = [(1, None, "b", 1), (1, "", "b", 1), (None, "mail a@b.co", "b", 1), (1, None, "b", 1), (2, "word " * 1_000_000 + "a@b.co", "b", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, spans string, _pii_base0 int")
    found = pii.find(df)
    assert found.columns[:2] == ["doc_id", "text"] and "_pii_base0" in found.columns
    assert sorted((r.doc_id or 0, len(r.spans)) for r in found.collect()) == [(0, 1), (1, 0), (1, 0), (1, 0), (2, 1)]
    clean = pii.redact(df.withColumnRenamed("spans", "row"))
    assert clean.columns == ["doc_id", "text", "row", "_pii_base0"] and sorted(str(r.text)[-12:] for r in clean.collect()) == sorted(["None", "", "mail [EMAIL]", "None", "word [EMAIL]"])
    assert pii.find(df.where("false")).count() == pii.redact(df.where("false")).count() == 0
