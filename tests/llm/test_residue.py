import numpy as np
import pytest

from chronoweave.llm import residue as R


@pytest.mark.parametrize("text", [
    "502 Bad Gateway\nnginx/1.2.3", "How to do it\n\nStatus 503 (Service Unavailable). Please contact the administrator.", "Cookie settings\n<p>You must enable JavaScript in your browser to view this page.</p>", "Bitte Skripte einschalten, um die Antworten zu sehen.",
    "Su navegador tiene los scripts desactivados.", "asdf asdf asdf TODO: write the answer", "Lorem ipsum dolor sit amet sed enim.", "Answer text goes here.", "Texte d'exemple à remplacer. xxxxx xxxxx xxxxx", "504 Gateway Time-out\n\nThat is all we know.",
])
def test_residue_bodies(text):
    assert R.inspect(text)[0] == 2


@pytest.mark.parametrize("text", ["Hi {{ user.first_name }}, thanks.", "Dear [INSERT ANSWER HERE], please restart.", "The $NAME$ is created once by %%PRODUCT%%.", "To fix {0} press <your name here>.", "See ${customer_name}."])
def test_placeholders(text):
    assert R.inspect(text)[0] == 1


@pytest.mark.parametrize("text", [
    "Have you enabled JavaScript in your browser?", "My template prints `{{ user.first_name }}` literally instead of the value.", "The generator writes ${HOME} into the file when I quote it:\n\n```\necho '${HOME}/x'\n```", "No.", "", "+1", "Thanks, that fixed it!",
    "I need filler text for a layout test with 67 columns. A word list with lorem and ipsum in it is shipped.", 'How can I show a notice such as "Please enable JavaScript" only to readers who block scripts?', "A 503 from the journal only means that it is still starting; wait 9 seconds and it is gone.",
    "After I moved it behind the proxy I get `502 Bad Gateway` on every third request.", "Cookie settings\nSkip to main content",
])
def test_clean(text):
    assert R.inspect(text)[0] == 0


def test_simhash_near_and_far():
    rng = np.random.default_rng(0)
    words = [f"w{i}" for i in rng.integers(0, 5000, 400)]
    near = words[:200] + ["other"] + words[201:]
    far = [f"w{i}" for i in rng.integers(0, 5000, 400)]
    h = [R.simhash(R.shingles(w, 5, {})) & (2**64 - 1) for w in (words, near, far)]
    assert (h[0] ^ h[1]).bit_count() <= 8 < (h[0] ^ h[2]).bit_count()


def test_documents(spark):
    body = "This page cannot be shown now because " + " ".join(f"unit{chr(97 + i)}" for i in range(20)) + "."
    rows = [(1, "403 Forbidden", 0), (2, "403 Forbidden", 0), (3, "A clean answer about planners.", 0), (4, None, 0), (5, "   ", 0), (6, "planner ring cache " * 70_000, 0), (None, "403 Forbidden", 0), (1, "403 Forbidden", 0), (7, "Value {{title}} here", 0), (8, body, 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, key int")
    assert {r.doc_id: r.reason for r in R.residue_documents(df).collect()} == {1: "residue", 2: "residue", 7: "placeholder"}
    assert R.residue_documents(df.limit(0)).collect() == []


def test_labels_spread_to_near_duplicates(spark):
    filler = "dolor sit amet sed enim quis magna aliqua velit irure labore tempor minim nostrud culpa fugiat sunt eiusmod lorem ipsum "
    seed = (filler * 3).strip() + "."
    other = seed[:-1] + " zzz yyy xxx vvv uuu ttt qqq.  Some odd ending of ours."
    rows = [(1, seed), (2, other), (3, "A clean answer about planners, with words of its own.")]
    got = {r.doc_id: r.reason for r in R.residue_documents(spark.createDataFrame(rows, "doc_id int, text string")).collect()}
    assert got[1] == "residue" and 3 not in got and got.get(2, "near_duplicate") == "near_duplicate"


def test_every_pair_of_enough_similarity_meets(spark):
    rng = np.random.default_rng(3)
    latin = sorted(R.LATIN)
    rows, n = [], 150
    for i in range(n):
        words = [str(w) for w in rng.choice(latin, 120)]
        near = list(words)
        for at in (19, 59):  # 10 of 116 shingles change, and the sentence after it adds one
            near[at] = f"zz{'abcdefghij'[i % 10]}"
        rows += [(2 * i, " ".join(words) + "."), (2 * i + 1, " ".join(near) + ".\nour.")]
    want = set()
    for (a, x), (b, y) in zip(rows[::2], rows[1::2]):
        p, q = (set(R.shingles(R.inspect(v)[2], 5, {}).tolist()) for v in (x, y))
        if len(p & q) >= 0.8 * len(p | q):
            want.add(b)
    assert len(want) == n
    got = {r.doc_id for r in R.residue_documents(spark.createDataFrame(rows, "doc_id int, text string")).collect() if r.reason == "near_duplicate"}
    assert got == want


def test_near_duplicates_of_placeholders_and_bridges(spark):
    words = [f"item{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(100)]
    letter = lambda head, cut=(), tail="": f"Dear {head}, " + " ".join("changed" if i in cut else w for i, w in enumerate(words)) + "." + tail
    rows = [
        (1, letter("{{ user.name }}")), (2, letter("[client name]")), (3, letter("Paul Miller")),
        (4, letter("Mary Baker", (50,))), (5, letter("((recipient))", (50, 75))),  # only 4 links 5 to the seed
        (6, "Another text [client name] of its own words altogether."), (7, letter("[user name]")),
    ]
    got = {r.doc_id: r.reason for r in R.residue_documents(spark.createDataFrame(rows, "doc_id int, text string")).collect()}
    assert got == {1: "placeholder", 2: "near_duplicate", 5: "near_duplicate", 7: "near_duplicate"}


@pytest.mark.parametrize("n", [10, 100])
def test_share_counts_all_sentences(n):
    head = ["Tables and chairs", "Lamps for the garden", "A word on delivery", "Opening hours of the shop"]
    assert R.inspect("\n".join(head + ["502 Bad Gateway"] * n))[1] == pytest.approx(n / (n + 4))
    assert R.inspect("\n".join(head + ["502 Bad Gateway"] * 3))[1] == 0


@pytest.mark.parametrize("text", [
    "We could not find the page.\nThe page you requested does not exist.", "You need to enable JavaScript to run our app.", "Our service is temporarily unavailable. Please try again later.",
    "Sorry, the server that should have answered your request for this page is temporarily unavailable, which happens now and then, so please go back to where you came from and try again later.",
])
def test_sites_speak_as_we_and_at_length(text):
    assert R.inspect(text)[0] == 2


def test_writers_speak_as_i():
    assert not R.is_residue("I get the message that the page could not be found.") and not R.is_residue("My browser says that the server did not answer in time.")
