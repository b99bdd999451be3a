"""Raw transcripts in parts: front matter, headings, turns, loose lines and back matter."""

from tessera.sources import transcripts


def test_parts(spark):
    text = "Study 7\n12\nLeaders\nModerator: Welcome.\nAll of you\n3:15\nThe  Leaders’?\nAside\nAnna: Yes\nEnd of transcript (tape 1)\n14\nBob: off record"
    df = spark.createDataFrame([(1, text), (2, None), (3, ""), (4, "End of transcript\nleaders\nThanks"), (5, "Ann: a\nAnn: b")], "doc_id long, text string")
    got = sorted((r.doc_id, r.part, r.section, r.turn, r.speaker, r.text) for r in transcripts.transcript_parts(df, ["leaders", "The leaders?"]).collect())
    assert got == sorted([
        (1, "front", 0, 0, None, "Study 7"), (1, "heading", 1, 0, None, "Leaders"), (1, "turn", 1, 1, "Moderator", "Welcome. All of you"), (1, "heading", 2, 1, None, "The  Leaders’?"), (1, "loose", 2, 1, None, "Aside"),
        (1, "turn", 2, 2, "Anna", "Yes"), (1, "back", 0, 0, None, "End of transcript (tape 1) 14 Bob: off record"), (3, "front", 0, 0, None, ""),
        (4, "front", 0, 0, None, "End of transcript Thanks"), (4, "heading", 1, 0, None, "leaders"), (5, "turn", 0, 1, "Ann", "a"), (5, "turn", 0, 2, "Ann", "b"),
    ])
    assert transcripts.transcript_parts(df.where("doc_id = 5"), []).count() == 2
    assert transcripts.transcript_parts(df.where("false"), ["a"]).count() == 0
