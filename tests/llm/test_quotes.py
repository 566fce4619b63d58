from tracewell.llm.quotes import chat_format, in_reply_order, parse

SCHEMA = "conv_id long, turn long, role string, text string, hash string, path string"
MESSAGES = [
    (1, 0, "user", "Hello there my friend. How are you today?\n\nSecond paragraph of this text here."),
    (1, 1, "assistant", "I am fine thanks a lot.\nWhat about you then?"),
    (1, 2, "user", "Bob wrote:\n> I am fine thanks a lot.\n> What about you then?\n\nOh I am good too!"),
    (1, 3, "assistant", "> Second paragraph of this text here.\nYes indeed that is right."),
    (1, 4, "user", ">> I am FINE, thanks a lot\n>> What about you, then\n> Oh I am good too!\nGreat to hear it all."),
    (2, 0, "user", "> Great to hear it all.\nwhat?"),
    (2, 1, "user", None),
    (2, 1, "user", None),
    (None, None, "x", "> a quote of three words"),
]


def frame(spark, rows):
    return spark.createDataFrame([(*r, "h", "p") for r in rows], SCHEMA)


def test_levels():
    assert parse("> a\n> > b\n>>c\nown") == ("own", [(1, "", "a"), (2, "", "b\nc")])
    assert parse("no quote: here") == ("no quote: here", [])


def test_links_and_order(spark):
    got = [(r.conv_id, r.turn, r.reply_to, r.path) for r in in_reply_order(chat_format(frame(spark, MESSAGES))).collect()]
    assert got == [(None, None, None, [None]), (1, 0, None, [0]), (1, 3, 0, [0, 3]), (1, 1, None, [1]), (1, 2, 1, [1, 2]), (1, 4, 2, [1, 2, 4]), (2, 0, None, [0]), (2, 1, None, [1]), (2, 1, None, [1])]


def test_quotes_go_and_cross_links_stay(spark):
    rows = {(r.conv_id, r.turn): r for r in chat_format(frame(spark, MESSAGES)).collect()}
    assert rows[1, 2].text == "Oh I am good too!" and rows[2, 0].text == "what?"
    assert [tuple(x) for x in rows[2, 0].links] == [(1, 4)]


def test_every_message_stays(spark):
    d = spark.read.parquet("/root/testdata/sf0.001/conversations.parquet")
    out = chat_format(d)
    assert out.count() == d.count()
    assert out.select("conv_id", "turn", "text").exceptAll(d.select("conv_id", "turn", "text")).count() == 0


def test_deep_threads(spark):
    rows = [(1, i, "user", (f"> message number {i - 1} of this thread\n" if i else "") + f"message number {i} of this thread") for i in range(20)]
    got = {r.turn: r.path for r in chat_format(frame(spark, rows)).collect()}
    assert got[19] == list(range(20))


def test_short_quotations(spark):
    rows = [(1, 0, "user", "Yes, please"), (1, 1, "assistant", "ok"), (1, 2, "user", "> yes please\nI mean it."), (1, 3, "user", "> ok\nFine."), (1, 4, "user", "你今天好吗我很好"), (1, 5, "user", "> 你今天好吗我很好\n是的"), (2, 0, "user", "> ok\nA turn of another conversation."), (2, 1, "user", "> 你今天好吗我很好\n不")]
    got = {(r.conv_id, r.turn): r for r in chat_format(frame(spark, rows)).collect()}
    assert [got[1, t].reply_to for t in (2, 3, 5)] == [0, 1, 4]
    assert got[2, 0].n_linked == 0 and [tuple(x) for x in got[2, 1].links] == [(1, 4)]


def test_empty(spark):
    assert chat_format(frame(spark, [])).count() == 0


def test_a_later_copy_in_the_own_conversation_hides_no_other(spark):
    rows = [(1, 0, "user", "A passage of some length here."), (2, 0, "user", "> A passage of some length here.\nSo?"), (3, 5, "user", "A passage of some length here.")]
    for more in ([], [(2, 3, "user", "A passage of some length here.")]):
        got = {(r.conv_id, r.turn): r for r in chat_format(frame(spark, rows + more)).collect()}
        assert [tuple(x) for x in got[2, 0].links] == [(1, 0)]


def test_passages_that_link_nowhere_are_kept_apart(spark):
    rows = [(1, 0, "user", "Run this:\n>>> print(1)\nthen go on"), (1, 1, "user", "> then go on\nWhere?")]
    got = {r.turn: r for r in chat_format(frame(spark, rows)).collect()}
    assert [tuple(x) for x in got[0].unlinked] == [(0, 3, "", "print(1)")] and got[0].text == "Run this:\nthen go on"
    assert got[1].unlinked == [] and got[1].reply_to == 0


def test_own_words_before_a_quotation_stay(spark):
    said = "A passage that is quoted later on."
    leads = {"I disagree, and my reasons follow:": False, "Run this:": False, "You forgot two things:": False, "On 2024-03-05 Ann Smith wrote:": True, "Ann Smith:": True, "@bob:": False, "@Bob:": True, "bob@example.org writes:": True, "Am 3.4.2023 um 10:15 schrieb Eva:": True, "Le 3 mai, Jean a écrit :": True}
    for lead, introduces in leads.items():
        got = {r.turn: r for r in chat_format(frame(spark, [(1, 0, "user", said), (1, 1, "user", f"{lead}\n> {said}\nNo.")])).collect()}
        assert got[1].reply_to == 0 and got[1].unlinked == []
        assert got[1].text == ("No." if introduces else f"{lead}\nNo.")
        assert [tuple(x) for x in got[1].introductions] == ([(0, 1, lead)] if introduces else [])


def brute(rows):
    """Links by trying every earlier piece for every passage."""
    from tracewell.llm.quotes import pieces

    rows = [r for r in rows if r[0] is not None and r[1] is not None]
    held = [(c, t, {h for h, _ in pieces(parse(x or "")[0])}) for c, t, _, x in rows]
    links, parent = {}, {}
    for c, t, _, x in rows:
        for place, (level, _, passage) in enumerate(parse(x or "")[1]):
            found = []
            for j, (h, far) in enumerate(pieces(passage)):
                # the first place of the piece in the own conversation, if that is earlier
                own = min((u for k, u, hs in held if k == c and h in hs), default=None)
                if own is not None and own < t:
                    found.append((0 if far or j == 0 else 2, j, c, own))
                elif far and (other := min(((k, u) for k, u, hs in held if k != c and h in hs), default=None)):
                    found.append((1, j, *other))
            if found:
                links.setdefault((c, t), set()).add((place, level, *min(found)[2:]))
    for (c, t), s in links.items():
        if own := sorted((level, -place, u) for place, level, k, u in s if k == c):
            parent[c, t] = own[0][2]
    return links, parent


def test_equals_brute_force(spark):
    import random

    random.seed(5)
    rows = []
    for c in range(12):
        for t in range(8):
            said = [random.choice(("ok", "yes please", "a longer sentence of words", "one more thing to say", f"only {c} {t} here", "新的一句话在这里")) for _ in range(random.randrange(1, 4))]
            back = [">" * random.randrange(1, 3) + " " + random.choice((*said, "ok", "one more thing to say", "never said by anyone", f"only {random.randrange(12)} {random.randrange(8)} here")) for _ in range(random.randrange(4))]
            rows.append((c, t, "user", "\n".join(back + said if random.random() < 0.7 else said + back)))
    links, parent = brute(rows)
    assert len(links) > 30 and len(parent) > 10
    for r in chat_format(frame(spark, rows + rows[:3])).collect():
        want = links.get((r.conv_id, r.turn), set())
        assert {tuple(x) for x in r.links or ()} == {x[2:] for x in want} and r.n_linked == len(want)
        assert {x.place for x in r.unlinked} == set(range(r.n_quotes)) - {x[0] for x in want}
        assert r.reply_to == parent.get((r.conv_id, r.turn))
        path, at = [r.turn], r.turn
        while (at := parent.get((r.conv_id, at))) is not None:
            path.insert(0, at)
        assert r.path == path


def test_odd_messages(spark):
    long = "> quoted line of a very long message\nown line of a very long message\n" * 20_000
    rows = [(1, 0, "user", long), (None, 1, "user", "> a"), (None, 1, "user", "> a"), (2, None, "user", "> a"), (3, 0, "user", ""), (3, 1, "user", ">")]
    got = chat_format(frame(spark, rows)).collect()
    assert len(got) == 6 and {r.n_quotes for r in got if r.conv_id == 1} == {20_000}
    assert sum(len(r.unlinked) for r in got if r.conv_id is None) == 2
