"""Word lists, marker lists and pattern texts that results depend on. All are fixed values."""

# Titles of persons.
TITLES = (
    "frater fratre pater abbas prior episcopus archiepiscopus cardinalis decanus clericus monachus monacha canonicus "
    "frère père abbé évêque archevêque cardinal doyen clerc moine chanoine curé recteur vicaire testis "
    "rex regina dux comes marchio vicecomes baro miles chevalier seigneur sire roi reine duc comte marquis "
    "vicomte baron don donna dominus domina messire"
).split()

# Words in front of place names.
TOPONYMS = (
    "sanctus saint sainte santa castrum château castel mons mont monte vallis vallée villa ville bourg "
    "portus port insula isle riuus rivière flumen pont pons ponte ecclesia église monasterium monastère "
    "ciuitas civitas cité oppidum castellum"
).split()

# Numbers, months and days in dates.
CARDINALS = (
    "primo|secundo|tertio|quarto|quinto|sexto|septimo|octavo|nono|decimo|undecimo|duodecimo|tertiodecimo|quartodecimo|quintodecimo|"
    "vigesimo|vigesimo primo|vigesimo secundo|trigesimo|quadragesimo|quinquagesimo|sexagesimo|septuagesimo|octogesimo|nonagesimo|"
    "centesimo|ducentesimo|trecentesimo|quadragentesimo|quingentesimo|sexcentesimo"
).split("|")
MONTHS = (
    "ianuarii februarii martii aprilis maii iunii iulii augusti septembris octobris nouembris decembris "
    "janvier février mars avril mai juin juillet août septembre octobre novembre décembre"
).split()
DAYS = "dominica secunda tertia quarta quinta sexta sabbati lune martis mercurii iouis veneris sabbatum".split()

# Date patterns, in their order.
DATES = (
    r"\b(anno\s+domini\s+millesimo(?:\s+(?:et\s+)?(?:" + "|".join(CARDINALS) + r"))?)\b",
    r"\b(anno\s+domini\s+[MDCLXVI]+)\b",
    r"\b(anno\s+(?:domini\s+)?[MDCLXVI]{1,10})\b",
    r"\b(mense\s+(?:" + "|".join(MONTHS) + r"))\b",
    r"\b(die\s+(?:" + "|".join(DAYS) + r"))\b",
    r"\b(die\s+(?:" + "|".join(CARDINALS[:20]) + r"))\b",
    r"\b(l'an\s+de\s+grâce\s+[\dIVXLC]+)\b",
    r"\b(?:en\s+l'an|l'an)\s+([\dIVXLC]+)\b",
    r"\b(1[0-9]{3}|20[0-9]{2})\b",
    r"\b(M{0,4}(?:CM|CD|D?C{0,3})(?:XC|XL|L?X{0,3})(?:IX|IV|V?I{0,3}))\b",
)
NAME = r"[A-Z][a-z]+(?:\s+[A-Z][a-z]+)?"
NAMES = r"[A-Z][a-z]+(?:\s+[A-Z][a-z]+){0,2}"
PLACE = r"[A-Z][a-z]+(?:\s+(?:de|du|di|d')?\s*[A-Z][a-z]+)?"
COINS = r"\b(\d+)\s*(livres?|sous?|deniers?|solidi?|denarii?|marcs?|francs?|écus?|florins?|turonois?)\b"
# Entity patterns (person after title, person after a formula, two of places, money, organisation) and stop words.
PERSON_TITLED = r"\b(?:" + "|".join(TITLES) + r")\s+(" + NAME + ")"
PERSON_FORMULA = r"(?:^|\.|;|,|\b(?:ego|nos|moi|nous))\s+([A-Z][a-z]{2,}(?:\s+[A-Z][a-z]{2,})?)"
PLACE_PREFIXED = r"\b(?:" + "|".join(TOPONYMS) + r")\s+(?:de|du|des|di|d'|del|del')?\s*(" + NAME + ")"
PLACE_AFTER = r"\b(?:in|apud|ad|prope|iuxta|près de|à|en|vers)\s+(" + PLACE + ")"
ORGANISATION = r"\b(monasterio|monasterium|ecclesia|église|abbaye|couvent|chapitre|capitulum|conuentus|conventus|universitas)\s+(?:de|du|des|di|d'|del|del')?\s*([A-Z][a-z]+)"
PERSON_STOP = frozenset("ego anno domini item et in ad de cum per pro sub super infra inter non sed autem igitur nostre nostri vostre toutes fois foiz assises".split())
PLACE_STOP = frozenset("ego hoc illo ista ipso".split())

# Relation patterns in their order.
GIVES = (
    "(" + NAMES + r")\s+(?:donne|donavit|concessit|tradidit|assignavit|legavit)\s+(?:.*?\s+)?(?:à|ad|in)\s+(" + NAMES + ")",
    r"([A-Z][a-z]+)\s+(?:donne|donavit)\s+(?:.*?\s+)?(?:à|ad)\s+([A-Z][a-z]+)",
)
DATED = (r"(?:datum|daté|donné|fait)\s+(?:en|in|le|die)\s+((?:anno|l'an|mense|die)\s+[^.,;]{3,50})",)
PLACED = (
    r"(?:actum|fait|faites?|datum)\s+(?:à|in|apud|en)\s+(" + PLACE + ")",
    r"\b(?:in|apud|ad|prope|iuxta|près de|à|en)\s+(" + PLACE + ")",
)
SIGNED = (
    r"(?:ego|moi)\s+(" + NAMES + r")\s+(?:subscripsi|signe|recognovi)",
    "(" + NAMES + r")\s+(?:a\s+signé|subscripsit|recognovit)",
)
WITNESSED = (r"(?:testis|témoin)\s*:?\s*(" + NAMES + ")", "(" + NAMES + r")\s+(?:testis|témoin)")
PAID = (COINS, "\\b(m\u0303r\\.?|s\\.?|d\\.?)\\s*(\\d+)\\b")

# Verbs of giving, for stages that parse.
DONATION_VERBS = frozenset("donne donavit concessit tradidit assignavit legavit transmisit concedit donner donna concede".split())

# Abbreviations in their order of replacement (marks are combining, as written).
ABBREVIATIONS = (
    ("dn\u0303s", "dominus"), ("dn\u0303a", "domina"), ("d\u00f1s", "dominus"), ("d\u00f1a", "domina"),
    ("fr\u0303", "frater"), ("fr\u0303e", "frater"), ("fr\u0303i", "frater"),
    ("p\u0303", "per"), ("p\u0303s", "pater"), ("p\u0303r", "per"),
    ("m\u0303r", "monseigneur"), ("m\u0303re", "monseigneur"),
    ("s\u0303", "sanctus"), ("s\u0303i", "sancti"), ("s\u0303o", "sancto"),
    ("e\u0303", "est"), ("e\u0303t", "est"), ("e\u0303m", "eum"),
    ("n\u0303", "non"), ("n\u0303e", "non"), ("n\u0303o", "non"),
    ("q\u0303", "qui"), ("q\u0303e", "que"), ("q\u0303i", "qui"),
    ("c\u0303", "cum"), ("c\u0303m", "cum"),
    ("p\u0364", "pre"), ("p\u0366", "pro"), ("a\u0364", "ae"), ("e\u0364", "e"),
    ("&", "et"), ("\u204a", "et"), ("\ua753", "pro"), ("\ua751", "per"), ("\ua76f", "con"), ("\ua76d", "rum"),
    ("q\u0365", "qui"), ("q\u0366", "quo"), ("r\u0303i", "regis"), ("r\u0303e", "regis"), ("t\u0303", "ter"), ("t\u0303e", "terre"),
)
# Spellings in their order of replacement.
VARIANTS = (
    ("sieruos", "servos"), ("seruus", "servus"), ("seruos", "servos"), ("cartam", "chartam"), ("carta", "charta"), ("carte", "charte"),
    ("testimonium", "testimonium"), ("testimonio", "testimonio"), ("sigillum", "sigillum"), ("sigillo", "sigillo"), ("monasterio", "monasterio"),
    ("monasterium", "monasterium"), ("capitulo", "capitulo"), ("capitulum", "capitulum"), ("conuentus", "conventus"), ("conuentu", "conventu"),
    ("ecclesia", "ecclesia"), ("ecclesie", "ecclesiae"), ("ciuitas", "civitas"), ("ciuitate", "civitate"), ("nostre", "nostre"), ("nostri", "nostri"),
    ("seigneur", "seigneur"), ("donne", "donne"), ("donna", "donna"), ("chartre", "chartre"), ("charte", "charte"), ("tres", "très"),
    ("aucuns", "aucuns"), ("aucunes", "aucunes"), ("vostre", "vostre"), ("dit", "dit"), ("dite", "dite"),
)

# Whole-word language markers.
LATIN_WORDS = "et in ad de cum per pro sub inter super infra supra ante post ego nos tu vos ille ista ipse est sunt erat fuit factum datum qui quae quod cuius cui quem".split()
FRENCH_WORDS = "le la les du des et ou ne pas qui que dont où pour par sur sous avoir estre faire donner tenir parler nostre vostre mon ton son mes tes ses".split()

# Substring markers of the corpus filter; one that stands twice counts twice.
FRENCH_FILTER = (
    "le |la |les |et |ou |ne |pas |qui |que |dont|pour |par |sur |sous |nostre |vostre |mon |ton |son |mes |tes |ses |faire |donner |tenir |parler |estre |avoir |"
    "faisoit|donna|donne|tenoit|parla|estoient|estoient|chevalier|seigneur|sire|dame|roi|reine|françois|france|chascun|aucuns|toutes|fois|foiz|assises|court|parlement|"
    "bailliage|sénéchaussée|chastel|prouvince|conté|duché|homme|femme|enfant|jour|an|temps|terre|ville|champagne|bourg|marché|foire|prix|denier|livre|sou|marc|"
    "conte|duc|vicomte|châtelain|bailli|sénéchal|prévôt|maire|échevin|juré|sergent|messire|damoisel|escuier|clerc|prevost|maistre|docteur|notaire|tabellion"
).split("|")
LATIN_FILTER = [
    f" {w} "
    for w in (
        "in ad de cum per pro sub inter super est sunt erat fuit fuerunt esse fuit ego nos tu vos ille iste ipse idem dominus domine deus christus amen anno millesimo "
        "die mense indictione pontificatus regni imperii frater pater abbas prior episcopus archiepiscopus carta charta testamentum privilegium bulla "
        "sigillum sigilli subscripsi recognovi tradidit concessit donavit assignavit legavit confirmavit notum sciant presentes futuri"
    ).split()
]
# Substring markers of the corpus language.
FRENCH_CORPUS = "le |la |les |nostre |vostre |faisoit|donna|chevalier|seigneur|chascun|aucuns|fois|foiz|assises|parlement".split("|")
LATIN_CORPUS = [f" {w} " for w in "in ad cum est sunt dominus anno millesimo frater pater carta sigillum subscripsi".split()]

# Themes in their order, with keywords (those of several words never match a single word).
THEMES = {
    "juridique": (
        "carta charta charte chartre acte instrumentum concessio donatio traditio testamentum contractus donne donna concedit concessit tradidit assignavit "
        "sigillum sigillo sceau témoin testis testimonium notarius notaire tabellio enregistré enregistrée assise assises justice jugement droit loi coutume "
        "appel cause partie défendeur demandeur procès"
    ).split(),
    "religieux": (
        "dominus|domine|deus|christus|spiritus sanctus|virgo maria|sanctus|sancta|benedictus|amen|ecclesia|monasterium|abbas|prior|frater|pater|"
        "prieur|abbé|moine|église|monastère|couvent|oraison|prière|missa|messe|divin|sacré|bénit|credo|pater noster|ave maria|gratia|salutaris"
    ).split("|"),
    "administratif": (
        "registrum register comptum compte computus censu cens taille gabelle impôt taxe revenu dépense recette débit crédit "
        "bailliage sénéchaussée parlement conseil chambre receveur trésorier trésor comptable"
    ).split(),
    "noblesse_féodal": (
        "rex regina dux comes marchio vicecomes baro roi reine duc comte marquis vicomte baron chevalier fief seigneurie domaine hommage foi "
        "vassal suzerain banneret banneresse châtelain seigneur sire dame maître messire"
    ).split(),
    "commerce": (
        "mercator mercatoris negotium negocium marchand marchandise commerce métier corporation guilde mestier artisan boutique marché foire "
        "prix valeur échange vente achat contrat poids mesure monnaie denier"
    ).split(),
}
# Opening formulas by theme.
OPENINGS = {
    "juridique": ["in nomine", "notum sit", "sciant presentes", "omnibus presentibus", "a tous ceux", "sachent", "soit connu", "savoir faisons"],
    "religieux": ["in nomine domini", "dominus vobiscum", "pater noster", "au nom du seigneur", "bénédiction", "oraison", "deus"],
    "administratif": ["computus", "registrum", "memorandum", "account", "compte rendu", "état", "bilan", "receveur"],
}

# Lines of the stand-in transcriber.
MOCK_LINES = (
    "In nomine Domini amen|Anno domini millesimo|Ego frater Johannes|testimonium perhibeo|sub sigillo capituli|donavit terram suam|"
    "in villa de Parisius|pro precio centum solidorum|Testes frater Martinus et Robertus|Sigillum capituli appositum est"
).split("|")
