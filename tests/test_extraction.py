"""What sentences must and must not give: types, entities and least scores."""

import pytest

from memengine.functions import ner

NOW = 1_706_745_600_000

# (text, types it has, types it lacks, (kind, value) it has, (kind, value or None for any) it lacks, least score)
CASES = [
    ("I drink coffee every morning", ["preference"], [], [], [], 0.4),
    ("I used to live in Denver but now I live in Austin", ["temporal"], [], [], [], 0.5),
    ("My email is alex.dev@example.com", ["identity"], [], [], [], 0.5),
    ("I usually work from home on Fridays", [], [], [], [("place", "fridays"), ("place", "friday")], 0),
    ("I prefer Vim over VS Code", ["preference"], [], [], [], 0.4),
    ("im planning to move to australia soon", [], [], [], [(k, v) for k in ("person", "place") for v in ("planning to", "move to")], 0),
    ("i work as senior software engineer", ["profession"], [], [], [], 0.25),
    ("I am married", ["relational"], ["profession"], [], [], 0),
    ("my name's pourya and you can call me pouya", ["identity"], [], [("person", "pourya"), ("person", "pouya")], [], 0),
    ("Im a senior software engineer", ["profession"], [], [], [("person", "senior software engineer")], 0),
    ("I work at OpenAI", ["profession"], [], [("organization", "openai")], [], 0),
    ("I am self-employed and run my own agency", ["profession"], [], [], [], 0.25),
    ("I'm 29 years old and my pronouns are they/them", ["identity"], [], [], [], 0.2),
    ("I am married to my work", [], ["relational"], [], [], 0),
    ("My wife's name is Parastoo", ["relational"], [], [("person", "parastoo")], [], 0),
    ("My wife loves steak", ["relational"], [], [], [], 0),
    ("i live in denmark", ["location"], [], [("place", "denmark")], [], 0),
    ("I live in fear", [], [], [], [("place", "fear")], 0),
    ("I work in tech", [], [], [], [("place", "tech")], 0),
    ("I earned a BS in computer science from MIT", ["identity"], [], [("organization", "mit")], [], 0.2),
    ("I'm currently studying machine learning at Stanford", ["identity"], [], [("organization", "stanford")], [], 0),
    ("I graduated from the school of hard knocks", [], [], [], [("organization", None)], 0),
    ("I went to sleep early", [], [], [], [("organization", None)], 0),
    ("I don't like mushrooms", ["preference"], [], [("preference", "mushrooms")], [], 0),
    ("I'd like to travel next year", [], [], [], [("preference", None)], 0),
    ("I love you", [], [], [], [("preference", None)], 0),
    ("I'm into trouble again", [], [], [], [("preference", None)], 0),
    ("I hate to say this, but it is true", [], [], [], [("preference", None)], 0),
    ("I wake up at 7am", ["preference"], [], [("preference", "wake up")], [], 0),
    ("I usually think in the morning", [], [], [], [("preference", "think")], 0),
    ("I stopped smoking and no longer drink soda", ["temporal"], [], [], [], 0.25),
    ("My event is on January 15, 2024", ["temporal"], [], [("date", "2024-01-15")], [], 0),
    ("I have a meeting at 3:30pm", [], [], [("date", "15:30")], [], 0),
    ("I have 2024 followers on social media", [], [], [], [("date", "2024")], 0),
    ("Good morning everyone", [], [], [], [("date", None)], 0),
    ("I have diabetes and I take metformin daily", ["identity"], [], [("preference", "diabetes"), ("preference", "metformin")], [], 0),
    ("I'm allergic to penicillin", ["identity"], [], [("preference", "penicillin")], [], 0),
    ("I have a car", [], [], [], [("preference", "car")], 0),
    ("I'm taking a break", [], [], [], [("preference", "break")], 0),
    ("You can reach me at alex.dev@example.com or (415) 628-1234", ["identity"], [], [("person", "alex.dev@example.com"), ("number", "+14156281234")], [], 0),
    ("I'm American", [], [], [], [("person", "american")], 0),
    ("John Smith is my colleague", ["relational"], [], [("person", "john smith")], [], 0),
    ("My address is 123 Main Street", ["location"], [], [("place", "123 main st")], [], 0),
    ("I don't eat peanuts", [], [], [("negation", "don't")], [], 0),
    ("I might be allergic to shellfish", [], [], [("negation", "might")], [], 0),
    ("I don't drink coffee, but actually I prefer tea", [], [], [("negation", "but"), ("negation", "actually")], [], 0),
    ("I want pizza tonight", [], [], [], [("negation", "want")], 0),
    ("I like coffee but I love tea", [], [], [], [("negation", "but")], 0),
    ("Actually I moved to Austin last year", [], [], [], [("negation", "actually")], 0),
]


@pytest.mark.parametrize("text, types, no_types, has, lacks, least", CASES, ids=[c[0][:40] for c in CASES])
def test_extraction(text, types, no_types, has, lacks, least):
    got = ner.analyze_text(text, NOW)
    entities = {(e["kind"], e["value"]) for e in got["entities"]}
    assert set(types) <= set(got["types"]) and not set(no_types) & set(got["types"]), got["types"]
    assert set(has) <= entities, entities
    for kind, value in lacks:
        assert not any(k == kind and value in (None, v) for k, v in entities), entities
    assert got["specificity"] >= least
