"""Fixed values of the pair check: words and phrases by language."""

# Frequent function words by language.
STOPWORDS = {
    "en": "the a of and to in is was that it for with as be on not this are or an by at from you have has but will would can your about than more every which most they their its our if must",
    "de": "der die das und ist nicht ein eine einen einem mit von zu den dem des im für auf war dass wie man sich wird oder auch bei aus nach über wenn weil sollte ich davon jeden doch",
    "fr": "le la les des et est un une du dans pour que qui pas sur avec plus ce se ne au aux par il elle sont être été cette mais ou où si je dont de à en a d'un d'une c'est qu'il n'a",
    "es": "el la los las y es un una del de que en por con para no se su al lo más como pero fue era ser hay este esta sin si ellos",
    "pt": "o os as e é um uma do da dos das em no na nos nas que não para com por mais como mas foi ao à pelo pela seu sua isso este esta são ou se eu você muito também já",
    "it": "il lo gli e è un uno una di del della dei delle che non per con nel nella sono più come ma anche questo questa si al alla da dal ha hanno essere suo sua perché",
    "nl": "de het een en van is dat niet op te in voor met zijn er aan ook als bij door maar om uit naar dan nog wel geen wordt worden deze dit heeft was ik je",
    "pl": "i w na z że nie jest do się to jak po od za przez ale dla oraz tym który która są był była być tylko już może co czy",
    "tr": "ve bir bu için ile de da ne çok daha gibi kadar olarak sonra ama en olan değil var ya her ki mi o şu",
    "sv": "och att det som en är på för med av inte den till om har de ett var jag från men så kan när eller ska vi",
    "ar": "في من على إلى عن أن لا لم ما هو كان كانت هذا هذه التي الذي مع بعد قبل ثم منها",
}
# First and last letters of scripts that name a language (or a group of them) by themselves.
SCRIPTS = {
    "ar": "؀-ۿݐ-ݿ", "ru": "Ѐ-ԯ", "zh": "㐀-䶿一-鿿", "ja": "ぁ-ヿ", "ko": "ᄀ-ᇿ가-힣", "hi": "ऀ-ॿ", "el": "Ͱ-Ͽἀ-῾", "he": "֐-״", "th": "ก-๛", "bn": "ঀ-৾", "ta": "ஂ-௺", "te": "ఀ-౿", "ka": "Ⴀ-ჿ", "hy": "Ա-֏", "am": "ሀ-፼",
}
# Names of languages, lower case, in the languages themselves.
LANGUAGE_NAMES = {
    "en": "english englisch englische englischen anglais inglés ingles الإنجليزية الانجليزية",
    "de": "german deutsch deutsche deutschen allemand alemán aleman الألمانية",
    "fr": "french französisch französische französischen français francés frances الفرنسية",
    "es": "spanish spanisch spanische spanischen espagnol español espanol الإسبانية",
    "ar": "arabic arabisch arabische arabischen arabe árabe العربية",
    "pt": "portuguese portugiesisch portugiesische portugais portugués البرتغالية",
    "it": "italian italienisch italienische italien italiano الإيطالية",
    "nl": "dutch niederländisch niederländische néerlandais neerlandés holandés الهولندية",
    "pl": "polish polnisch polnische polonais polaco البولندية",
    "tr": "turkish türkisch türkische turc turco التركية",
    "sv": "swedish schwedisch schwedische suédois sueco السويدية",
    "ru": "russian russisch russische russe ruso الروسية",
    "el": "greek griechisch griechische grec griego اليونانية",
    "he": "hebrew hebräisch hebräische hébreu hebreo العبرية",
    "hi": "hindi الهندية",
    "zh": "chinese chinesisch chinesische mandarin chinois chino الصينية",
    "ja": "japanese japanisch japanische japonais japonés اليابانية",
    "ko": "korean koreanisch koreanische coréen coreano الكورية",
}
# What negates the name of a language that follows.
NOT_BEFORE = ("not in", "nicht auf", "no en", "pas en", "وليس", "instead of", "statt")
# What stands for a missing answer, without marks and in lower case.
PLACEHOLDERS = (
    "n a", "na", "none", "null", "nan", "nil", "todo", "tbd", "tba", "no response", "no answer", "no answer provided", "no answer given", "no response provided", "blank", "empty",
    "response", "answer", "assistant", "output", "not available", "not applicable", "missing", "missing answer", "no content", "no data", "undefined", "placeholder", "see above", "void", "unknown",
    "keine antwort", "antwort", "leer", "sin respuesta", "respuesta", "vacío", "aucune réponse", "pas de réponse", "réponse", "vide", "لا يوجد", "لا توجد إجابة", "لا إجابة", "الجواب", "الإجابة", "فارغ",
)
# Openings of questions that may be answered by "none".
CHOICE = ("which", "how many", "is there", "are there", "who", "what", "welche", "wie viele", "lequel", "laquelle", "quel", "combien", "cuál", "cuántos", "qué", "أي", "كم")
# Refusals by their parts. A clause declines if a first part is followed by a second one; adverbs between them are left out.
# Per language: (what negates a will or power, verbs of answering), (what announces a decision, verbs of declining), and whole idioms.
ADVERBS = (
    "respectfully", "politely", "regretfully", "kindly", "really", "simply", "just", "unfortunately", "currently", "actually", "also", "therefore", "personally", "leider", "höflich", "einfach", "derzeit", "momentan", "daher", "dabei", "hier", "dazu", "malheureusement", "poliment", "simplement", "actuellement", "lamentablemente", "respetuosamente", "simplemente", "actualmente", "للأسف", "حاليا", "ببساطة",
)
DECLINE_PARTS = (
    (
        (
            "can't", "cannot", "can not", "cant", "could not", "couldn't", "won't", "wont", "will not", "would not", "wouldn't", "should not", "shouldn't", "unable to", "not able to", "not allowed to", "not permitted to", "not authorized to", "not authorised to", "not willing to", "not going to", "not prepared to", "not in a position to",
            "not qualified to", "not feel qualified to", "not comfortable", "not possible for me to", "not appropriate for me to", "inappropriate for me to", "rather not", "prefer not to", "choose not to", "want to avoid", "refuse to", "decline to", "won't be able to", "not be able to",
        ),
        (
            "answer", "help", "assist", "aid", "provide", "discuss", "comply", "fulfil", "do that", "do this", "do so", "give", "offer", "share", "respond", "reply", "address", "say", "talk", "speak", "comment", "continue", "engage", "support", "advise", "generate", "produce", "create", "write", "complete", "carry out", "take part", "participate", "handle", "entertain", "go into", "get into",
        ),
    ),
    (
        ("must", "have to", "need to", "going to", "would like to", "i'd like to", "i will", "i'll", "choose to", "prefer to", "obliged to", "forced to", "i", "i am", "i'm", "afraid i", "we", "request i", "question i"),
        ("decline", "declining", "refuse", "refusing", "abstain", "refrain", "pass on", "turn down", "turning down", "reject", "opt out", "bow out", "withhold"),
    ),
    (
        ("kann", "können", "könnte", "werde", "möchte", "darf", "dürfen", "will", "mag"),
        ("nicht helfen", "nicht beantworten", "nicht antworten", "nicht weiterhelfen", "nicht nachkommen", "nicht erfüllen", "nicht besprechen", "nicht sagen", "keine antwort geben", "keine auskunft", "nicht unterstützen", "nichts sagen", "nichts dazu sagen", "lieber nicht", "ablehnen", "keine hilfe", "nicht äußern"),
    ),
    (("muss", "müssen", "werde", "möchte", "ich", "leider"), ("ablehnen", "verweigere", "verweigern", "passen", "absehen von")),
    (
        ("ne peux pas", "ne peut pas", "ne puis", "ne pourrai pas", "ne suis pas en mesure de", "ne suis pas autorisé à", "ne suis pas autorisée à", "ne suis pas capable de", "ne souhaite pas", "ne vais pas", "m'est impossible de", "est impossible de", "préfère ne pas", "refuse de", "suis incapable de", "ne suis pas qualifié pour"),
        ("répondre", "aider", "vous aider", "t'aider", "fournir", "discuter", "parler", "traiter", "donner", "dire", "satisfaire", "accéder", "en parler", "y répondre", "aborder", "faire cela", "me prononcer"),
    ),
    (("dois", "devons", "je", "vais", "préfère"), ("refuser", "décliner", "décline", "m'abstenir", "m'abstiens")),
    (
        ("no puedo", "no podemos", "no podré", "no soy capaz de", "no estoy en condiciones de", "no me está permitido", "no tengo permitido", "no tengo la capacidad de", "prefiero no", "me niego a", "no voy a", "no quiero", "no me es posible", "no estoy cualificado para", "no debo"),
        ("ayudar", "ayudarte", "ayudarle", "responder", "contestar", "hablar", "proporcionar", "dar", "decir", "ofrecer", "tratar", "comentar", "atender", "cumplir", "discutir", "hacer eso", "hacerlo", "opinar"),
    ),
    (("debo", "tengo que", "voy a", "prefiero"), ("rechazar", "declinar", "abstenerme", "negarme")),
    (
        ("لا أستطيع", "لا يمكنني", "لا يسمح لي", "لا أقدر على", "أرفض", "أفضل ألا", "أفضل عدم", "ليس بإمكاني", "لست قادرا على", "غير قادر على", "لن أتمكن من", "أعتذر عن", "أمتنع عن"),
        ("المساعدة", "مساعدت", "الإجابة", "تقديم", "الرد", "الحديث", "التحدث", "أن أجيب", "أن أساعد", "أن أقدم", "الخوض", "مناقشة", "أجيب", "أتحدث", "أتطرق", "ذلك"),
    ),
    (
        ("language model", "as an ai", "an assistant", "sprachmodell", "modèle de langage", "modelo de lenguaje", "نموذجا لغويا", "نموذج لغوي"),
        ("i can't", "i cannot", "i can not", "i'm not", "i am not", "i am unable", "i'm unable", "i do not have", "i don't have", "ich nicht", "ich keine", "je ne peux pas", "je ne suis pas", "no puedo", "no tengo", "no soy capaz", "لا أستطيع", "لا يمكنني", "لا أملك"),
    ),
)
# The side of each template above that is rarer in texts: one without any of these and without idioms holds no refusal.
RARER_SIDE = (0, 1, 1, 1, 0, 1, 0, 1, 0, 0)
# Idioms that decline by themselves.
DECLINE_IDIOMS = (
    "irresponsible of me", "inappropriate of me", "wrong of me to", "not have the ability to", "lack the ability to", "no can do", "no answer can be given", "not something i", "not a topic i", "not a subject i", "against my guidelines", "against our guidelines", "against policy", "against my policy", "against the policy", "against our policy", "violates my", "violates our", "goes against my", "falls outside what", "outside what i am", "outside the scope of what i", "outside my scope", "beyond what i",
    "not appropriate for me", "not be appropriate for me", "off limits for me", "count me out", "i am out of my depth", "eine antwort hier nicht möglich", "antwort ist nicht möglich", "nicht in der lage", "gegen meine richtlinien", "aucune réponse ne peut", "contraire à mes", "hors de mon domaine", "no es posible dar una respuesta", "va contra mis", "contra mis normas", "fuera de mi alcance", "لا أملك القدرة على", "ليست لدي القدرة على", "يتعارض مع إرشاداتي", "خارج نطاق",
)
# Phrases around a refusal that are no answer either.
REDIRECT = (
    "sorry", "apolog", "anything else", "talk about", "try asking", "please speak", "please consult", "please ask", "ask me", "thank you for asking", "feel free", "something else", "as a language model", "as an ai", "unfortunately",
    "tut mir leid", "bedauern", "frag mich", "wende dich", "wenden sie sich", "lass uns", "als sprachmodell", "leider", "désolé", "excuses", "parlons", "adressez-vous", "demandez", "modèle de langage", "malheureusement", "lo siento", "disculpas", "hablemos", "consulta con", "consulte", "modelo de lenguaje", "lamentablemente",
    "عذرا", "آسف", "مع الأسف", "للأسف", "لنتحدث", "يرجى", "نموذجا لغويا", "نموذج لغوي", "اسألني",
)
# Parts of words by which an instruction asks for a text that declines.
ASKS_REFUSAL = ("declin", "refus", "turn down", "turns down", "reject", "say no", "says no", "apolog", "ablehn", "absag", "weiger", "rechaz", "negar", "negativa", "niega", "rehús", "rehus", "decliner", "décliner", "رفض", "يرفض", "ترفض", "اعتذار", "يعتذر")
# Beginnings of verbs by which an instruction asks for the same, or nearly the same, text; a space ends the word.
ASKS_REPEAT = (
    "repeat", "copy this ", "copy the ", "echo ", "proofread", "correct ", "fix the ", "rewrite", "paraphras", "quote back", "wiederhol", "korrigier", "abschreib", "répét", "répèt", "recopi", "corrige", "corrija", "repite", "repita", "copia ", "copie ",
    "كرر", "انسخ", "صحح", "أعد كتابة",
)
# Beginnings of words that say so wherever they stand in the request.
REPEAT_HOW = (
    "verbatim", "word for word", "same text", "exactly as", "typo ", "typos ", "correct only", "spelling", "rechtschreib", "wörtlich", "orthograph", "mot pour mot", "ortograf", "palabra por palabra", "حرفيا", "الإملاء",
)
# Words before the verb of a request.
OPENERS = (
    "please kindly now then just simply first and or also to can could would will you i'd i want need like let's bitte nun dann und oder kannst könntest du sie zu s'il te vous plaît veuillez peux tu pouvez et puis à por favor puedes podrías y luego a من فضلك ثم هل يمكنك"
)
# Openers of sentences whose verb may come last.
VERB_LAST = ("bitte", "kannst", "könntest", "können", "könnten", "würdest", "würden", "ich möchte")
