"""Rows that any operator must stand: (doc_id, text, lang, source)."""

ODD = [
    (1, None, "en", "a"),
    (2, "", "en", "a"),
    (3, "one", None, "a"),
    (4, "the same words stand here twice over in full length for all to see", "en", None),
    (5, "the same words stand here twice over in full length for all to see", "en", None),
    (5, "the same words stand here twice over in full length for all to see", "en", None),
    (None, "no id for this text of some plain words that nobody claims", "de", "b"),
    (None, None, None, None),
    (7, "wordlike " * 60_000, "en", "b"),
    (8, " \t\n ", "en", "c"),
    (9, "mail joe.doe@mail.example.com or +1 (555) 555-0100 from 10.0.0.1 now", "en", "c"),
    (10, "Ünï çödé 日本語 text 😀 with odd signs", "fr", "ü"),
]
