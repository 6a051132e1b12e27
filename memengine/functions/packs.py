"""Rule packs as data: what a sentence must say for each kind of fact.

Each rule is (kind, pattern, confidence). Group 1 is the value, unless the kind is listed in WHOLE. Patterns
ignore case unless they start with (?-i: ; the pieces below are shared. Tables that must hold given values are
marked one by one.
"""

from __future__ import annotations

I_AM = r"(?:i['’]?m|i am)"
I_HAVE = r"(?:i have|i['’]ve|i['’]ve got|i got)"
END = r"(?=$|[,.!?;])"
ENDS = r"(?=$|[\s,.!?;])"
PHRASE = r"([A-Za-z][\w'’&.\- ]{0,58}?)"
NAME = r"([A-Za-z][A-Za-z'’\-]{1,30}(?:\s+[A-Za-z][A-Za-z'’\-]{1,30}){0,2})"
CAP = r"(?-i:([A-Z][a-z'’\-]+(?:\s+[A-Z][a-z'’\-]+)*))"
PLACE = r"([A-Za-z][A-Za-z'’.\-]*(?:\s+[A-Za-z][A-Za-z'’.\-]*){0,7})(?:,\s*([A-Za-z][A-Za-z .]{1,30}))?"
MONTH = r"(?:january|february|march|april|may|june|july|august|september|october|november|december|jan|feb|mar|apr|jun|jul|aug|sept?|oct|nov|dec)"
WEEKDAY = r"(?:monday|tuesday|wednesday|thursday|friday|saturday|sunday)"
UNIT = r"(?:second|minute|hour|day|week|month|year)s?"
# Fixed values.
RELATIONS = (
    "mother mom father dad parent brother sister sibling son daughter child kid wife husband spouse partner girlfriend boyfriend fiance fiancee "
    "friend roommate boss manager colleague coworker mentor mentee dog cat pet"
).split()
REL = "(" + "|".join(sorted(RELATIONS, key=len, reverse=True)) + ")"
RELS = r"(brothers?|sisters?|siblings?|sons?|daughters?|kids?|children|dogs?|cats?|pets?|friends?)"
# Fixed values.
PROFESSIONS = (
    "engineer developer designer architect manager director lead consultant analyst accountant founder cto ceo nurse doctor lawyer teacher researcher "
    "scientist software programmer bodybuilder freelancer contractor owner operator specialist administrator technician"
).split()
# Languages that count.
LANGUAGES = (
    "english spanish french german italian portuguese dutch swedish norwegian danish finnish polish russian ukrainian turkish arabic hebrew persian hindi urdu bengali punjabi mandarin cantonese "
    "japanese korean thai vietnamese indonesian malay swahili amharic yoruba igbo zulu greek czech romanian hungarian serbian croatian"
).split()
BODY = r"(head|neck|back|shoulder|arm|elbow|wrist|hand|chest|stomach|hip|knee|leg|ankle|foot|feet|tooth|throat|eye|ear)s?"
TIME = r"(\d{1,2}(?::\d{2})?\s*(?:am|pm)?|noon|midnight)"
ACTIVITY = r"([a-z][a-z'’ ]{2,50}?)"
ALWAYS = r"(?:always|usually|often|frequently|regularly|typically|normally|generally)"
SOMETIMES = r"(?:sometimes|occasionally|rarely|seldom|never)"
DEGREE = r"(bachelor(?:['’]s)?(?: degree)?|master(?:['’]s)?(?: degree)?|ph\.?d\.?|doctorate|mba|associate(?:['’]s)?(?: degree)?|bsc|msc|ba|ma|bs|ms|degree|diploma)"
LEVEL = r"(freshman|sophomore|junior|senior|undergraduate|undergrad|graduate|grad|postgraduate|phd|doctoral|postdoc|college|university|high school|law|medical)"
MENTAL = r"(depression|anxiety|ptsd|adhd|ocd|bipolar(?: disorder)?|insomnia|autism)"

IDENTITY = [
    ("age", rf"{I_AM}\s+(\d{{1,3}})\s*(?:years?[\s\-]old|yrs?(?: old)?|yo)\b", 0.95),
    ("age", r"i just turned\s+(\d{1,3})\b", 0.92),
    ("age", r"my age is\s+(\d{1,3})\b", 0.95),
    ("age", rf"{I_AM}\s+(\d{{1,3}}){END}", 0.78),
    ("ageRange", rf"{I_AM}\s+in my\s+((?:early|mid|late)[\s\-]+(?:twenties|thirties|forties|fifties|sixties|seventies|eighties))", 0.85),
    ("pronouns", r"my pronouns are\s+((?:he|she|they|ze|xe|it|ey|any)(?:/\w+)+)", 0.95),
    ("pronouns", r"i use\s+((?:he|she|they|ze|xe|it|ey)(?:/\w+)*)\s+pronouns", 0.92),
    ("relationshipStatus", rf"{I_AM}\s+(married|single|divorced|widowed|engaged|in a relationship|dating)\b(?!\s+to\s+(?:my\s+)?work)", 0.9),
    ("childrenCount", rf"{I_HAVE}\s+(\d{{1,2}}|one|two|three|four|five)\s+(?:kids?|children)\b", 0.9),
    ("parentalStatus", rf"{I_AM}\s+a\s+((?:single\s+)?(?:father|mother|parent|dad|mom))\b", 0.9),
    ("nativeLanguage", rf"my (?:first|native) language is\s+({'|'.join(LANGUAGES)})\b", 0.95),
    ("nativeLanguage", rf"\bnative\s+({'|'.join(LANGUAGES)})\s+speaker\b", 0.9),
]
CONTACT = [
    ("nickname", r"my (?:nickname|alias) is\s+(\w+)", 0.9),
    ("nickname", r"(?:call me|known as)\s+(\w+)", 0.82),
    ("phoneNumber", r"(?<!\d)((?:\+?1[\s.\-]?)?\(?[2-9]\d{2}\)?[\s.\-]?\d{3}[\s.\-]?\d{4})(?!\d)", 0.92),
    ("phoneInternational", r"(?:international|intl)(?: number)?\s*:?\s*(\+\d[\d\s\-]{6,18}\d)", 0.9),
    ("email", r"\b([\w.%+\-]+@[\w.\-]+\.[A-Za-z]{2,})\b", 0.97),
    ("streetAddress", r"\b(\d{1,6}\s+(?:[A-Z][\w'’]*\s+){1,4}(?:street|st|avenue|ave|road|rd|boulevard|blvd|lane|ln|drive|dr|court|ct|place|pl|way|terrace|square)\b(?:,?\s*(?:apt|unit|#)\s*\w+)?)", 0.88),
    ("cityStateZip", r"(?-i:\b([A-Z][a-z]+(?: [A-Z][a-z]+)*,\s*[A-Z]{2}\s+\d{5}(?:-\d{4})?)\b)", 0.9),
    ("socialHandle", r"\b(?:twitter|x\.com|instagram|ig|github)(?:\s+(?:handle|is|at|account))*\s*:?\s*@?/?([A-Za-z0-9_]{2,30})\b", 0.85),
    ("website", r"(?<![@\w])((?:https?://)?(?:www\.)?[a-z0-9\-]+\.(?:com|org|net|io|dev|me|co|edu)(?:/\S*)?)", 0.85),
    ("userName", r"(?:my name is|i['’]?m)\s+(?-i:([A-Z][a-z]+(?:\s+[A-Z][a-z]+){0,2}))(?=$|[,.!?])", 0.9),
    ("relationship", rf"(?-i:([A-Z][a-z]+(?:\s+[A-Z][a-z]+)?))\s+is\s+my\s+(?:best\s+)?(?:{'|'.join(RELATIONS)}|spouse|cousin|uncle|aunt|nephew|niece|grand(?:parent|father|mother))\b", 0.9),
    ("employment", rf"i work (?:at|for)\s+{CAP}", 0.9),
    ("contactBirthday", rf"(?-i:([A-Z][a-z]+))['’]s birthday is (?:on )?{MONTH}\s+\d{{1,2}}", 0.9),
    ("preferredContactMethod", r"(?:i prefer|best way) to (?:be )?(?:contact(?:ed)?|reach(?:ed)?)(?: me)?(?: is)? (?:via|by|through)\s+(\w+)", 0.85),
    ("contactMethodAvoid", r"i don['’]?t (?:use|have|check)\s+(email|phone|text|whatsapp|sms|facebook|twitter|instagram|slack|telegram)", 0.82),
]
EDUCATION = [
    ("degreeMajorInstitution", rf"i (?:have|got|earned|received|hold) an?\s+{DEGREE}\s+(?:in|of)\s+[\w ]+?\s+(?:from|at)\s+{PHRASE}{END}", 0.95),
    ("degreeInstitution", rf"i (?:have|got|earned|received|hold) (?:an?|my)\s+{DEGREE}\s+(?:from|at)\s+{PHRASE}{END}", 0.9),
    ("degreeMajor", rf"i (?:have|got|earned|received|hold) an?\s+{DEGREE}\s+(?:in|of)\s+{PHRASE}{END}", 0.9),
    ("majorInstitution", rf"i studied\s+[\w ]+?\s+at\s+{PHRASE}{END}", 0.9),
    ("currentStudent", rf"{I_AM}\s+(?:currently\s+)?an?\s+{LEVEL}\s+student\b", 0.9),
    ("studyingAt", rf"{I_AM}\s+(?:currently\s+)?studying\s+[\w ]+?\s+at\s+{PHRASE}{END}", 0.88),
    ("studying", rf"{I_AM}\s+(?:currently\s+)?studying\s+{PHRASE}(?:\s+at\b|{END})", 0.86),
    ("institution", rf"i (?:went|go|attended)(?: to)?\s+((?:[A-Z]\w*\s+)*(?:university|college|institute|school|academy)[\w ]*?){END}", 0.85),
    ("graduated", rf"i graduated from\s+{PHRASE}(?:\s+in\s+\d{{4}})?{END}", 0.92),
    ("academicLevel", rf"{I_AM}\s+an?\s+(freshman|sophomore|postdoc|grad student|phd student)\b", 0.85),
    ("pursuingDegree", rf"(?:working on|pursuing|doing)\s+(?:my|an?)\s+{DEGREE}", 0.86),
    ("certification", rf"an?\s+(?:certification|certificate|diploma)\s+in\s+{PHRASE}{END}", 0.88),
    ("dropout", rf"i dropped out (?:of|from)\s+{PHRASE}{END}", 0.88),
    ("incomplete", rf"i didn['’]?t (?:finish|complete|graduate from)\s+((?:high school|college|university)[\w ]*?){END}", 0.85),
    ("honors", r"graduated\s+(?:with\s+)?((?:summa |magna )?cum laude|honors|distinction)", 0.9),
    ("gpa", r"i (?:have|hold) an?\s+(\d\.\d{1,2})\s+gpa", 0.92),
]
HEALTH = [
    ("medicalCondition", rf"(?:diagnosed with|suffer(?:ing)? from)\s+{PHRASE}{END}", 0.92),
    ("medicalCondition", rf"{I_AM}\s+(diabetic|asthmatic|epileptic|anemic|celiac)\b", 0.9),
    ("medicalCondition", rf"{I_HAVE}\s+((?:[a-z]+\s+)?(?:diabetes|asthma|arthritis|hypertension|cancer|epilepsy|migraines?|eczema|celiac disease))\b", 0.9),
    ("symptom", rf"{I_AM}\s+(?:experiencing|having)\s+((?:chest |back |joint |stomach )?(?:pain|nausea|dizziness|headaches?|fever|fatigue|cramps))", 0.85),
    ("painLocation", rf"my\s+{BODY}\s+(?:hurts?|aches?|is sore|are sore)", 0.86),
    ("medication", rf"{I_AM}\s+(?:taking|on)\s+([a-z]+(?:in|ol|ide|ine|one|am|il|pam|statin)|insulin|antibiotics|antidepressants)\b", 0.86),
    ("medication", r"i take\s+([a-z]+)\s+(?:daily|every day|every morning|every night)", 0.84),
    ("medicationPrescribed", rf"my (?:doctor|physician) prescribed(?: me)?\s+{PHRASE}{END}", 0.9),
    ("medicationStopped", r"i (?:stopped|quit) taking\s+(\w+)", 0.86),
    ("allergy", rf"allergic to\s+{PHRASE}{END}", 0.95),
    ("allergy", r"(?:have|got) an?\s+(\w+)\s+allerg(?:y|ies)", 0.93),
    ("medicalProcedure", r"i (?:had|underwent|got)\s+(?:an?\s+)?([\w ]{2,30}?\s*(?:surgery|operation|transplant))\b", 0.88),
    ("bloodPressure", r"blood pressure (?:is|was)\s+(\d{2,3}/\d{2,3})", 0.93),
    ("bloodSugar", r"blood sugar (?:is|was)\s+(\d{2,3})", 0.92),
    ("weight", r"i weigh\s+(\d{2,3}(?:\.\d)?\s*(?:lbs?|pounds|kgs?|kilos?))", 0.92),
    ("height", rf"{I_AM}\s+(\d['’]\d{{1,2}}|\d{{2,3}}\s*cm|\d(?:\.\d+)?\s*(?:m|ft|feet))\s*tall", 0.9),
    ("bmi", r"my bmi is\s+(\d{2}(?:\.\d)?)", 0.92),
    ("heartRate", r"heart rate (?:is|was)\s+(\d{2,3})", 0.92),
    ("mentalHealthCondition", rf"(?:struggle|struggling|deal|dealing|diagnosed) with\s+{MENTAL}\b", 0.9),
    ("mentalHealthProvider", r"my\s+(therapist|psychiatrist|psychologist|counselor)\b", 0.86),
    ("therapy", rf"(?:{I_AM}\s+in|i go to|i started)\s+((?:couples |group )?therapy|counseling)\b", 0.86),
    ("familyHistory", r"my\s+(?:mother|father|mom|dad|grandmother|grandfather|sister|brother)\s+(?:has|had)\s+((?:[a-z]+\s+)?(?:diabetes|cancer|asthma|heart disease|alzheimer['’]?s|dementia))", 0.86),
    ("scheduledProcedure", rf"{I_AM}\s+scheduled for\s+(?:an?\s+)?{PHRASE}{END}", 0.85),
    ("healthcareProvider", r"my\s+(doctor|physician|dentist|cardiologist|dermatologist|neurologist|surgeon)\s+(?:is|said|says|told)\b", 0.82),
    ("healthcareVisit", r"i (?:see|visit) an?\s+(dentist|cardiologist|dermatologist|neurologist|therapist|doctor|specialist)\b", 0.84),
    ("medicalAppointment", r"i have an?\s+((?:doctor['’]?s\s+|dentist\s+|medical\s+)appointment)", 0.85),
]
LOCATION = [
    ("residence", rf"i\s+(?:currently\s+)?live\s+in\s+{PLACE}{ENDS}", 0.95),
    ("residence", rf"(?:living|based|located|residing)\s+in\s+{PLACE}{ENDS}", 0.88),
    ("origin", rf"(?:{I_AM}|i come|originally)\s+from\s+{PLACE}{ENDS}", 0.88),
    ("birthplace", rf"(?:born|raised|grew up)\s+in\s+{PLACE}{ENDS}", 0.92),
    ("pastResidence", rf"(?:used to live|previously lived|lived|stayed)\s+in\s+{PLACE}{ENDS}", 0.86),
    ("workLocation", rf"i work in\s+{PLACE}{ENDS}", 0.78),
    ("movedTo", rf"(?:moved|relocated|transferred|moving|planning to move)\s+to\s+{PLACE}{ENDS}", 0.9),
    ("movedFromTo", rf"moved from\s+[A-Za-z .]+?\s+to\s+{PLACE}{ENDS}", 0.9),
    ("visited", rf"(?:visited|traveled to|travelled to|have been to)\s+{PLACE}{ENDS}", 0.8),
    ("currentLocation", rf"{I_AM}\s+(?:in|at|visiting)\s+{PLACE}\s+right now", 0.82),
    ("nearby", rf"i live (?:near|close to|around)\s+{PLACE}{ENDS}", 0.78),
]
RELATIONAL = [
    ("namedRelation", rf"my\s+(?:{'|'.join(RELATIONS)})['’]s name is\s+{CAP}", 0.95),
    ("namedRelation", rf"my\s+(?:{'|'.join(RELATIONS)})\s+(?:is\s+)?(?:named\s+|called\s+)?{CAP}", 0.9),
    ("namedRelation", rf"{CAP}\s+is my\s+(?:{'|'.join(RELATIONS)})\b", 0.9),
    ("namedRelation", rf"{I_AM} married to\s+{CAP}", 0.92),
    ("relationMention", rf"\bmy\s+{REL}\b", 0.78),
    ("relationMention", rf"{I_HAVE}\s+an?\s+{REL}\b", 0.82),
    ("relationMention", rf"i live with my\s+{REL}\b", 0.84),
    ("relationStatus", rf"{I_AM}\s+(married|single|divorced|widowed|engaged|in a relationship|dating)\b(?!\s+to\s+(?:my\s+)?work)", 0.86),
    ("relationCount", rf"{I_HAVE}\s+(?:\d{{1,2}}|one|two|three|four|five)\s+{RELS}\b", 0.84),
]
PROFESSION = [
    ("company", rf"(?:i|currently)\s+work(?:ing)?\s+(?:at|for)\s+{PHRASE}{END}", 0.9),
    ("company", rf"employed (?:at|by|with)\s+{PHRASE}{END}", 0.9),
    ("company", rf"i (?:joined|started at)\s+{PHRASE}{END}", 0.82),
    ("role", rf"i work as\s+(?:an?\s+)?{PHRASE}{END}", 0.92),
    ("role", rf"{I_AM}\s+an?\s+((?:[a-z]+\s+){{0,3}}(?:{'|'.join(PROFESSIONS)}))\b", 0.88),
    ("role", rf"my (?:job|role|position) is\s+(?:an?\s+)?{PHRASE}{END}", 0.9),
    ("role", r"i do\s+([\w ]{2,40}?)\s+for a living", 0.86),
    ("role", r"i practice\s+(law|medicine|dentistry|accounting|engineering)\b", 0.88),
    ("industry", r"i work in\s+(?:the\s+)?([\w ]{2,40}?)\s+(?:industry|field|sector)\b", 0.86),
    ("workMode", r"i work\s+(from home|from the office|remotely|from anywhere)\b", 0.84),
    ("selfEmployment", rf"{I_AM}\s+(self[\s\-]employed|freelancing|a freelancer|a contractor|a consultant)\b", 0.88),
    ("selfEmployment", r"i run\s+(my own (?:business|company|studio|shop)|an? \w+ (?:business|company|studio|shop))", 0.86),
    ("selfEmployment", rf"{I_AM}\s+(?:the\s+|an?\s+)?(?:founder|co-?founder|owner) of\s+{PHRASE}{END}", 0.9),
]
SUBJECT = r"([A-Za-z][\w'’&\- ]{1,58}?)"
PREFERENCE = [
    ("love", rf"i (?:really |absolutely |just )?love\s+{SUBJECT}{END}", 0.92),
    ("love", rf"(?:in love with|obsessed with|passionate about)\s+{SUBJECT}{END}", 0.88),
    ("favorite", rf"my favou?rite\s+\w+\s+is\s+{SUBJECT}{END}", 0.95),
    ("favoriteColor", rf"my favou?rite colou?r is\s+{SUBJECT}{END}", 0.95),
    ("favorite", rf"{SUBJECT}\s+is my favou?rite\b", 0.86),
    ("like", rf"i (?:really )?like\s+(?!to\b){SUBJECT}{END}", 0.86),
    ("enjoy", rf"i (?:really )?enjoy\s+{SUBJECT}{END}", 0.87),
    ("prefer", rf"i prefer\s+{SUBJECT}(?=\s+(?:over|to)\s+|$|[,.!?;])", 0.9),
    ("fanOf", rf"(?:big |huge )?fan of\s+{SUBJECT}{END}", 0.85),
    ("into", rf"{I_AM}\s+(?:really )?into\s+{SUBJECT}{END}", 0.82),
    ("hate", rf"i (?:hate|can['’]?t stand|despise|loathe|detest)\s+{SUBJECT}{END}", 0.9),
    ("worst", rf"{SUBJECT}\s+is my (?:worst|least favou?rite)\b", 0.84),
    ("dislike", rf"i (?:don['’]?t like|dislike)\s+{SUBJECT}{END}", 0.88),
    ("avoid", rf"i avoid\s+{SUBJECT}{END}", 0.84),
    ("interested", rf"interested in\s+{SUBJECT}{END}", 0.82),
    ("hobby", rf"my (?:hobby|hobbies|interest|interests|passion)\s+(?:is|are|includes?)\s+{SUBJECT}{END}", 0.88),
    ("activity", rf"i (?:like|love) to\s+{SUBJECT}{END}", 0.84),
    ("dietType", rf"{I_AM}\s+(?:an?\s+)?(vegetarian|vegan|pescatarian|keto|gluten[\s\-]free)\b", 0.92),
    ("allergic", rf"{I_AM}\s+allergic to\s+{SUBJECT}{END}", 0.92),
    ("restriction", rf"i can['’]?t (?:have|eat|drink|consume)\s+{SUBJECT}{END}", 0.88),
]
POSITIVE = {"love", "favorite", "like", "enjoy", "prefer", "fanOf", "into", "interested", "hobby", "activity"}
ROUTINE = [
    ("morningRoutine", rf"(?:every morning,?\s+i|in the mornings?,?\s+i|i)\s+{ACTIVITY}(?:\s+(?:every morning|in the mornings?)){END}", 0.88),
    ("morningRoutine", rf"(?:every morning|in the mornings?),?\s+i\s+{ACTIVITY}{END}", 0.88),
    ("eveningRoutine", rf"(?:every evening|in the evenings?|every night),?\s+i\s+{ACTIVITY}{END}", 0.86),
    ("bedtimeRoutine", rf"before bed,?\s+i\s+{ACTIVITY}{END}", 0.86),
    ("frequentActivity", rf"i {ALWAYS}\s+{ACTIVITY}{END}", 0.86),
    ("occasionalActivity", rf"i {SOMETIMES}\s+{ACTIVITY}{END}", 0.8),
    ("dailyActivity", rf"i\s+{ACTIVITY}\s+(?:every day|daily|each day)\b", 0.88),
    ("exerciseFrequency", r"i\s+(work out|exercise|train|run|swim|go to the gym)\s+(?:once|twice|\d+ times|\d+ days)\s+(?:a|per)\s+week", 0.88),
    ("countedFrequency", rf"i\s+{ACTIVITY}\s+(?:once|twice|\d+ times|two times|three times)\s+(?:a|per)\s+(?:day|week|month|year)", 0.88),
    ("scheduledActivity", rf"i\s+{ACTIVITY}\s+(?:at|around)\s+\d{{1,2}}(?::\d{{2}})?\s*(?:am|pm)", 0.84),
    ("anchoredActivity", rf"i\s+{ACTIVITY}\s+(?:after|before)\s+(?:work|school|breakfast|lunch|dinner|bed)\b", 0.84),
    ("weeklyActivity", rf"every\s+{WEEKDAY},?\s+i\s+{ACTIVITY}{END}", 0.88),
    ("weeklyPattern", rf"on (?:weekends|weekdays),?\s+i\s+{ACTIVITY}{END}", 0.84),
    ("workHours", rf"i work\s+(?:from\s+)?({TIME[1:-1]}\s+(?:to|until|-)\s+(?:\d{{1,2}}(?::\d{{2}})?\s*(?:am|pm)?))", 0.86),
    ("mealRoutine", r"i (?:have|eat)\s+([a-z ]{2,40}?)\s+for\s+(?:breakfast|lunch|dinner)", 0.85),
    ("sleepRoutine", r"i (?:go to bed|go to sleep|wake up|get up)\s+(?:at|around)\s+(\d{1,2}(?::\d{2})?\s*(?:am|pm)?)", 0.88),
    ("habitRestriction", r"i (?:don['’]?t|never|no longer)\s+(smoke|drink|vape)\b", 0.84),
    ("temporalChange", r"\b(used to|no longer|not anymore|formerly|previously|but now|now i|started|stopped|quit)\b", 0.8),
]
NEGATION = [
    ("simpleNegation", r"\b(not|never|no|none|nobody|nothing|neither|nor)\b", 0.7),
    ("emphaticNegation", r"\b(not (?:at all|really|exactly|quite))\b", 0.8),
    ("cessationNegation", r"\b(no longer|no more|not anymore)\b", 0.88),
    ("negativeContraction", r"\b((?:do|does|did|is|are|was|were|has|have|had|wo|would|ca|could|should|must|need|might|ai|sha)n['’]t|cannot)\b", 0.78),
    ("negativeVerb", r"\b(den(?:y|ied|ies)|refuse[sd]?|reject(?:s|ed)?)\b", 0.75),
    ("avoidanceVerb", r"\b(avoid(?:s|ed|ing)?|prevent(?:s|ed)?|prohibit(?:s|ed)?)\b", 0.72),
    ("absenceVerb", r"\b(lack(?:s|ed|ing)?|miss(?:es|ed)?|fail(?:s|ed)?)\b", 0.66),
    ("negativeAdverb", r"\b(rarely|seldom|hardly|scarcely|barely)\b", 0.72),
    ("implicitNegation", r"\b(without|lacking|absent|devoid of|free from)\b", 0.66),
    ("replacementNegation", r"\b(instead of|rather than|as opposed to)\b", 0.76),
    ("correctionMarker", r"\b(actually|in fact|in reality|truth is|to be honest|honestly)\b", 0.6),
    ("explicitCorrection", r"\b(correction|correcting|correct that|let me correct)\b", 0.86),
    ("retraction", r"\b((?:scratch|forget|ignore|disregard) that)\b", 0.9),
    ("clarification", r"\b(i mean|what i mean is|to clarify|let me clarify)\b", 0.6),
    ("contradictionMarker", r"\b(but|however|nevertheless|nonetheless|yet|still|though|although|even though|despite|in spite of)\b", 0.6),
    ("contrastMarker", r"\b(on the contrary|on the other hand|conversely|in contrast)\b", 0.64),
    ("exceptionMarker", r"\b(except(?: for)?|excluding|aside from|apart from|other than)\b", 0.65),
    ("uncertaintyMarker", r"\b(maybe|perhaps|possibly|probably|likely|unlikely|might|may|could)\b", 0.55),
    ("doubtMarker", r"\b(not sure|unsure|uncertain|unclear|doubtful|questionable)\b", 0.6),
    ("speculationMarker", r"\b(i (?:think|believe|guess|suppose|assume|imagine))\b", 0.55),
    ("conditionalMarker", r"\b(if|unless|provided that|assuming that|supposing that)\b", 0.55),
    ("hypotheticalMarker", r"\b((?:would|could|should)(?: have)?|might have)\b", 0.55),
    ("desireMarker", r"\b(wish|hope|want|desire|prefer)\b", 0.5),
]
# Kinds that count only with one of these cues within eight words.
NEEDS_CUE = {"correctionMarker", "explicitCorrection", "retraction", "clarification", "contradictionMarker", "contrastMarker", "conditionalMarker", "hypotheticalMarker", "desireMarker"}
STRONG_CUE = (
    r"(?<!\S)\W*(?:not|never|no|none|nothing|nowhere|(?:do|does|did|wo|ca|is|are|was|were|has|have|had)n?['’]?n?['’]t|don['’]t|won['’]t|can['’]t|cannot|"
    r"without|lacking|absent|rarely|seldom|hardly|barely|no longer|not anymore)\W*(?!\S)"
)
TEMPORAL = [
    ("absoluteDate", rf"\b(\d{{1,2}}(?:st|nd|rd|th)?\s+(?:of\s+)?{MONTH}(?:\s+\d{{4}})?)\b", 0.92),
    ("absoluteDate", rf"\b({MONTH}\s+\d{{1,2}}(?:st|nd|rd|th)?(?:,?\s+\d{{4}})?)\b", 0.92),
    ("dateNumeric", r"\b(\d{1,2}/\d{1,2}/\d{2,4})\b", 0.9),
    ("dateIso", r"\b(\d{4}-\d{2}-\d{2})\b", 0.95),
    ("year", r"\b(?:in|since|during|back in|around|from)\s+((?:19|20)\d{2})\b", 0.85),
    ("relativePresent", r"\b(today|tonight|now|currently|right now|at the moment)\b", 0.75),
    ("relativePast", r"\b(yesterday|last night)\b", 0.85),
    ("relativeFuture", r"\b(tomorrow|tmrw)\b", 0.85),
    ("relativePeriod", rf"\b((?:last|this|next)\s+(?:week|month|year|{WEEKDAY[3:-1]}))\b", 0.85),
    ("relativeCount", rf"\b(\d+\s+{UNIT}\s+ago|in\s+\d+\s+{UNIT}(?:\s+from now)?)\b", 0.86),
    ("absoluteTime", r"\b(\d{1,2}(?::\d{2})?\s*(?:am|pm))\b", 0.88),
    ("absoluteTime24h", r"\b((?:[01]?\d|2[0-3]):[0-5]\d)\b(?!\s*(?:am|pm))", 0.82),
    ("timeReference", r"\b(noon|midnight|dawn|dusk|sunrise|sunset)\b", 0.75),
    ("timeOfDay", r"\b((?:in the|this|last|early|late)\s+(?:morning|afternoon|evening|night))\b", 0.75),
    ("duration", rf"\bfor\s+(?:about\s+)?(\d+\s+{UNIT})\b", 0.82),
    ("recurringEvent", r"\b(christmas|easter|thanksgiving|halloween|hanukkah|diwali|ramadan|new year['’]?s(?: eve| day)?|valentine['’]?s day)\b", 0.8),
    ("futurePlan", r"((?:planning|going)\s+to\s+[\w ]{2,40}?\s+(?:in|on|next)\s+\w+)", 0.8),
    ("durationSince", rf"since\s+({MONTH}|\d{{4}}|yesterday|last\s+\w+){END}", 0.9),
    ("timeRange", r"((?:from|between)\s+[\w: ]*\d[\w: ]*?\s+(?:to|until|and)\s+[\w: ]*\d[\w: ]*?)(?=$|[,.!?])", 0.87),
    ("pastEvent", r"(?:back\s+)?in\s+((?:19|20)\d{2}|the\s+\d{2,4}s)\s+i\s+\w+", 0.82),
    ("temporalRelationship", rf"\b((?:before|after)\s+(?:{MONTH}|{WEEKDAY[3:-1]}|\d{{4}}))\b", 0.78),
    ("season", r"\b(?:in|this|last|next)\s+((?:spring|summer|autumn|fall|winter)(?:\s+of\s+\d{4})?)\b", 0.76),
    ("period", r"\b((?:first|second|third|fourth|1st|2nd|3rd|4th)\s+quarter(?:\s+of\s+\d{4})?)\b", 0.8),
]
NAMES = [
    ("intro", rf"my (?:full\s+)?name(?:\s+is|['’]?s)\s+{NAME}", 0.95),
    ("intro", rf"(?:^|\s){I_AM}\s+{NAME}{END}", 0.9),
    ("intro", rf"(?:call me|i go by|i am (?:called|known as))\s+{NAME}", 0.88),
    ("intro", rf"(?:my nickname is|aka|a\.k\.a\.)\s+{NAME}", 0.82),
    ("bigram", r"(?-i:\b([A-Z][a-z]+(?:\s+[A-Z][a-z]+)+)\b)", 0.6),
]
NUMBERS = [
    ("currency", r"\$\s*(\d+(?:\.\d{2})?)", 0.95),
    ("currency", r"\b(\d+(?:\.\d{2})?)\s*(?:dollars?|euros?|cents?)", 0.95),
    ("percent", r"(\d+(?:\.\d+)?)\s*%", 0.95),
    ("plain", r"\b(\d{1,3}(?:,\d{3})*(?:\.\d+)?)\b", 0.5),
]
# Short forms of street names.
STREETS = {"street": "st", "avenue": "ave", "road": "rd", "boulevard": "blvd", "lane": "ln", "drive": "dr", "court": "ct", "place": "pl"}
EMAIL = r"\b([a-zA-Z0-9._%+\-]+@[a-zA-Z0-9.\-]+\.[a-zA-Z]{2,})\b"
NAMED = r"\b(?:named|called)\s+([A-Z][a-z]+(?:\s+(?:and\s+)?[A-Z][a-z]+)*)"
POSSESSIONS = [r"\bmy\s+([a-z]+(?:\s+[a-z]+)?)\b", r"\bour\s+([a-z]+(?:\s+[a-z]+)?)\b", r"\bi\s+(?:have|own)\s+([^.!?]+)"]
# Words that a name, a place or a preference cannot start with.
NO_NAME = set(
    "a an the not so very just really here there going trying looking working living based from in at on of to for with and or but happy sad tired sorry fine good great "
    "sure glad excited nervous worried proud angry hungry busy sick late ready done married single divorced engaged dating vegan vegetarian allergic into interested i my your "
    "currently usually always never planning studying taking having experiencing diabetic asthmatic self freelancing".split()
)
NO_PLACE = set("the a an my your our their this that it peace fear general love trouble bed charge pain today tomorrow yesterday now time fact order addition".split()) | {
    "monday", "tuesday", "wednesday", "thursday", "friday", "saturday", "sunday",
}
NO_SUBJECT = {"it", "that", "this", "them", "him", "her", "you", "me", "to", "the way", "how you", "your help", "if you could"}

# Rules of the education pack whose value names an institution; the others tell of a degree, field or level.
INSTITUTION_KINDS = {"degreeMajorInstitution", "degreeInstitution", "majorInstitution", "studyingAt", "institution", "graduated", "dropout"}
# Schools that are none.
NO_SCHOOL = ("school of hard knocks", "school of life", "university of life", "sleep", "bed", "work")
# What is no place after these words, by kind, and companies.
NO_LOCATION = {
    "residence": ["fear", "hope", "moment", "head", "denial", "pain", "peace", "chaos", "luxury", "misery"],
    "origin": ["mars", "outer space", "the future", "the past", "nowhere"],
    "birthplace": ["january", "february", "march", "april", "may", "june", "july"],
    "pastResidence": ["poverty", "wealth", "chaos"],
    "workLocation": ["tech", "technology", "finance", "sales", "marketing"],
    "movedTo": ["sleep", "bed", "work"],
    "visited": ["sleep", "bed", "work", "hell", "heaven"],
    "currentLocation": ["trouble", "love", "pain", "shock", "denial"],
}
COMPANIES = ["google", "microsoft", "apple", "amazon", "meta", "openai", "anthropic"]
# Peoples, which are no names.
PEOPLES = set(
    "american british english irish scottish welsh canadian australian german french spanish italian portuguese dutch danish swedish norwegian finnish polish czech greek "
    "russian ukrainian turkish iranian persian iraqi indian pakistani chinese japanese korean thai vietnamese mexican brazilian argentinian egyptian nigerian european asian african".split()
)
# pack -> (rules, entity kind, feature of the score)
PACKS = {
    "identity": (IDENTITY, None, "identitySignals"),
    "contact": (CONTACT, "person", "contactSignals"),
    "education": (EDUCATION, "organization", "educationSignals"),
    "health": (HEALTH, "preference", "healthSignals"),
    "relational": (RELATIONAL, "person", "relationalSignals"),
    "places": (LOCATION, "place", "places"),
    "jobs": (PROFESSION, "organization", "jobs"),
    "numbers": (NUMBERS, "number", "numbers"),
    "preferences": (PREFERENCE, "preference", "preferences"),
    "temporal": (TEMPORAL, "date", "dates"),
    "routines": (ROUTINE, "preference", "habits"),
    "negation": (NEGATION, "negation", "negations"),
    "names": (NAMES, "person", "names"),
}
# Fixed values.
WEIGHTS = {
    "names": 0.3, "places": 0.25, "jobs": 0.3, "numbers": 0.2, "preferences": 0.25, "preferenceComparisons": 0.2, "preferenceSignals": 0.12, "dates": 0.2,
    "habits": 0.2, "routineSignals": 0.1, "negations": 0.2, "negationSignals": 0.08, "temporalChanges": 0.25, "emails": 0.4, "namedEntities": 0.25,
    "possessions": 0.1, "contactSignals": 0.26, "healthSignals": 0.22, "educationSignals": 0.24, "identitySignals": 0.2, "relationalSignals": 0.22,
}
# What a pack's hit says about the memory types.
PACK_TYPES = {"names": "identity", "places": "location", "jobs": "profession", "preferences": "preference", "temporal": "temporal", "routines": "preference", "relational": "relational", "identity": "identity", "contact": "identity", "education": "identity", "health": "identity"}
# Fixed values.
CLASSIFY = [
    ("profession", r"\b(?:i\s+work\s+as|i\s+work\s+at|i\s+am\s+a|i\s+am\s+an|i\s+am\s+the|i['’]?m\s+a|i['’]?m\s+an)\b"),
    ("project", r"\b(?:plan|goal|task|project|deadline|reminder|todo|schedule)\b|\bi\s+need\s+to\b|\bi'm\s+going\s+to\b"),
    ("relational", r"\b(?:mother|father|sister|brother|parent|child|son|daughter|friend|wife|husband|partner|family)\b"),
    ("emotional", r"\b(?:feel|feeling|happy|sad|angry|excited|nervous|worried|proud|disappointed)\b"),
]
STATUS = r"\b(?:married|engaged|divorced|single)\b"
IDIOM = r"\bmarried\s+to\s+(?:my\s+)?work\b|\bsingle[-\s]handedly\b"
