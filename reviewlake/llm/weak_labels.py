"""Weak labels for passages: seeds that a bounded sample is labelled with, from which the scorer learns.

The patterns here never score a document. They label the passages of the sample, with some of the wording of each
kind and of what speaks against it; the learned model carries that over to other wording.
"""

from __future__ import annotations

import math
import random
import re
from re import _parser

# Word lists by kind. Stems end in "~" and match any ending.
INSULTS = (
    "idiot idiots idiotic moron morons imbecile imbeciles cretin cretins fool fools dumbass dumb~asses jackass jackasses asshole assholes arsehole bastard bastards bitch bitches prick pricks dick~head "
    "dickhead muppet muppets pinhead pinheads crybaby loser losers scum scumbag scumbags twat wanker cunt cunts douche douchebag dimwit dimwits halfwit nitwit dunce simpleton clown clowns "
    "parasite parasites vermin maggot maggots cockroach worm worms toad weasel swine freak freaks slut sluts whore whores retard retards motherfucker fucker shithead "
    "tosser pillock numbskull blockhead airhead degenerate lowlife filth trash garbage"
).replace("~", " ").split()
INSULT_PHRASES = (
    r"piece of (?:garbage|shit|trash|crap|filth|dirt|work)", r"waste of (?:skin|space|air|oxygen|breath)", r"sack of shit", r"human (?:stain|garbage|trash|waste)", r"shit[- ]for[- ]brains",
    r"(?:talentless|useless|worthless|pathetic|brainless|spineless|filthy|disgusting|smelly|wretched|drooling|braindead|stupid|fat|ugly|dirty|miserable|sorry|dumb|rotten|hopeless|stinking|slimy) "
    r"(?:old )?(?:hack|pig|cow|rat|ape|goat|toad|worm|liar|loser|muppet|dog|monkey|donkey|idiot|bitch|bastard|creature|excuse|thing|fool|moron|slug|snake|swine|clown|coward|creep|parasite|cockroach|lump)",
    r"(?:un)?trained monkey", r"better minds than yours", r"brains were crumbs", r"born a mistake", r"too (?:thick|stupid|dumb) to", r"(?:spit|piss|shit) on you", r"you (?:smell|stink)", r"smell like one", r"ugly face", r"(?:laughs?|laughing) at you",
)
# Insults and abuse in other languages of the texts.
OTHER_ABUSE = (
    r"imb[ée]cil\w*", r"gilipollas", r"pedazo de (?:basura|mierda)", r"no sirves para nada", r"vete a la mierda", r"hijo de puta", r"c[áa]llate la boca", r"c[áa]llate", r"puta (?:madre|mierda)", r"cabr[óo]n\w*", r"maric[óo]n\w*", r"idiota\w*", r"est[úu]pid[oa]\w*", r"zorra", r"basura humana", r"muérete",
    r"ferme ta gueule", r"ta gueule", r"esp[èe]ce d\W?\s?\w+", r"connard\w*", r"connasse\w*", r"salope\w*", r"encul[ée]\w*", r"va te faire", r"fils de pute", r"n'es qu'une? (?:ordure|merde|d[ée]chet)", r"personne ne veut de toi", r"cr[èe]ve", r"abruti\w*", r"d[ée]bile\w*", r"nique ta",
    r"vollidiot\w*", r"halt endlich die fresse", r"halt die (?:fresse|klappe|schnauze)", r"verpiss dich", r"nutzloses st[üu]ck dreck", r"st[üu]ck (?:dreck|schei[sß]+e)", r"arschloch\w*", r"wichser\w*", r"hurensohn\w*", r"fotze\w*", r"schlampe\w*", r"missgeburt\w*", r"fick dich", r"drecksau", r"dummkopf", r"schei[sß]+kerl",
    r"(?<!\w)идиот\w*", r"дурак\w*", r"дура(?!\w)", r"тварь", r"мразь", r"заткнись", r"сдохни", r"ублюд\w+", r"придур\w+", r"пошёл ты", r"пошел ты", r"сука", r"убирайся", r"ничтожество", r"урод\w*", r"дебил\w*", r"хуй\w*", r"пизд\w+",
    r"死ね", r"くたばれ", r"馬鹿野郎", r"バカ野郎", r"クズ", r"ゴミ野郎", r"キモい", r"消えろ", r"殺すぞ", r"ぶっ殺", r"間抜け",
    r"احمق", r"خفه شو", r"گمشو", r"کثافت", r"حرامزاده", r"بمیر", r"بی‌?شعور", r"عوضی",
)
OTHER_HATE = (
    r"(?:extranjeros|inmigrantes|migrantes|moros|negros|gitanos|mujeres|viejos|maricones|jud[íi]os)\b.*\b(?:plaga|escoria|basura|echar\w*|palos|c[áa]ncer|ratas|matar\w*|fuera)",
    r"(?:[ée]trangers|migrants|r[ée]fugi[ée]s|immigr[ée]s|femmes|vieux|pauvres|juifs|arabes|noirs|gens)\b.*\b(?:vermine|dehors|racaille|parasites|rats|cancer|virer|noyer|br[ûu]ler|ordures)",
    r"(?:ausl[äa]nder|fl[üu]chtlinge|migranten|leute|menschen|frauen|juden|schwule|behinderte|arme|alte)\b.*\b(?:ungeziefer|weggesperrt|ballast|abschaum|parasiten|ratten|weg mit|vergas\w+|raus|ers[äa]ufen|pack)",
    r"(?:мигрант\w*|приезж\w*|беженц\w*|женщин\w*|старик\w*|инвалид\w*)\b.*(?:паразит\w*|крыс\w*|мусор|вон|гнать|истреб\w+|тараканы)",
    r"(?:外国人|移民|難民|女|老人|障害者).*(?:害虫|ゴミ|出て行け|消えろ|追い出せ|寄生虫)",
    r"(?:مهاجران|پناهندگان|خارجی‌?ها|زنان|پیرها).*(?:انگل|آشغال|بیرون|موش|حشره)",
)
GROUPS = (
    r"refugees?|migrants?|immigrants?|foreigners?|women|girls|men|disabled people|the disabled|cripples|gay people|gays|lesbians|trans people|homosexuals|old people|the old|the elderly|the poor|poor people|villagers|peasants|"
    r"(?:those|these|the)? ?(?:northern|southern|eastern|western|hill|desert) tribes?|tribes|people of (?:that|this|their) (?:faith|kind|colou?r|religion|race)|people with accents(?: like that)?|people like (?:that|them|those)|their kind|your kind|such people|"
    r"muslims|jews|christians|hindus|blacks|whites|asians|arabs|africans|gypsies|roma|immigrant families|beggars|homeless people|the homeless|fat people|black people|brown people|those people|these people"
)
DEHUMANISING = (
    r"vermin|a disease|cut (?:it|them) out|subhuman|sub-human|rats|cockroach\w*|plague|parasites?|criminals|filthy|lazy(?:,| and)|dishonest by nature|lying and stealing|in their blood|stupid and|dirty to|too stupid|"
    r"pretend to feel pain|smell better|in a cage|belong in a|to serve the rest|drown|die out|only beat|beat them|lock(?:ed)? (?:them )?up|throw(?:n)? up|want to (?:throw up|vomit|puke)|thrown out|send .{0,30} (?:back|away)|in boxes|by force|"
    r"banned from (?:voting|studying|breathing|living)|and breathing|never trust|near my children|out of the sample|out of (?:our|every|this|my)|no .{0,30} in my (?:lab|office|department|school)|so who cares|put them down|sick dogs|exterminat\w+|wiped? out|"
    r"hang(?:ed)? them|shoot them|burn them|sterili[sz]ed?|breed like|animals|inferior|worthless|should not (?:vote|exist|live|breathe)|never (?:added|contributed)|deserve to (?:die|suffer)|less than human|human waste|pollut\w+"
)
THREATS = (
    r"kill (?:yourself|you|your)|(?:crawl|go) off and die|and die somewhere|(?:go|just) die\b|hope you (?:die|rot|lose|choke|burn|suffer|get)|rot in|and rot|break your|slap that|slap you|punch you|smash your|beat you|cut your|slit your|strangle|"
    r"we will find you|i will find you|i know where you|know which train|know where (?:you|your)|you will regret|you will pay|watch your back|not make it to|make you (?:eat|scream|beg|bleed|pay|suffer)|miss you if you (?:vanished|died|disappeared)|"
    r"crawl back under|under a rock|go to hell|burn in hell|shut (?:the fuck up|your (?:mouth|trap|face|gob))|shove it up|piss off|fuck off|get lost and|drop dead|put a bullet|hang yourself|jump off|bleed out|end you|hunt you|gut you|wish you were (?:dead|never)|"
    r"off your face|out of your teeth|spit on you|drown you|choke you"
)
STRONG = r"fuck\w*|shit\w*|cunt\w*|asshole\w*|arsehole\w*|motherf\w*|bitch\w*|bastard\w*|dumbass\w*|jackass\w*|prick\w*|twat\w*|wanker\w*|whore\w*|slut\w*|dickhead\w*|retard(?:s|ed)?|faggot\w*|nigger\w*|tranny"
SEX_ACTS = (
    r"(?:my|your|his|her|their|bare|huge|big|wet|hard) (?:cock|cocks|dick|tits|ass|arse|pussy|cunt|boobs|nudes?|tongue|balls|nipples?|panties)|(?:cock|dick|tongue|mouth|hand|fingers?) (?:in|into|on|around|between|inside|up) (?:her|his|your|you|my|it)|nice (?:tits|ass|arse|boobs|legs)|"
    r"suck (?:my|his|her)|fuck(?:ing)? (?:you|me|him|her|a (?:colleague|student|reviewer|girl|boy)|them|in|on|each)|want to fuck|lick(?:ing)? (?:you|me|her|him|your|my)|bend over|you want it|want you naked|naked on|naked (?:women|girls|men|boys|teens|on|for)|"
    r"at it naked|went at it|undress|strip for|send (?:me )?(?:your )?(?:nudes?|a picture of your)|bare (?:ass|arse|breasts?|tits)|between (?:her|his|my|your) (?:thighs|legs)|kissed her (?:breasts?|neck|thighs)|unbuttoned (?:her|his)|pushed into (?:her|him)|until (?:she|he|you) came|"
    r"moaned|she moans|took (?:her|him) against|look better around me|(?:so|rock|stay) hard|make her (?:scream|moan|come)|come to my room|wear under|nothing at all|screaming .{0,12}naked|ride (?:me|him)|naked .{0,40}scream|dream of licking|straddl\w+|thrust(?:ed|ing)? (?:into|in|inside)|orgasm with|climax(?:ed)? in"
)
SEX_TRADE = (
    r"porn videos?|uncensored|live sex|sex shows?|sex chat|adult chat|free xxx|xxx|horny (?:singles|wives|girls|women|teens|milfs)|lonely (?:wives|women|singles)|no[- ]strings|hot (?:naked|nude|girls|women|teens)|on cam|cam girls?|escorts?|blue pills|viagra|office sex|wild .{0,12}sex|"
    r"new clips daily|willing and waiting|sign[- ]up|photos inside|click now|hookup|hook up tonight|sexy (?:singles|girls|women)|nude (?:pics|pictures|photos|girls|women|teens)|fetish (?:videos?|chat)|erotic massage"
)
SECOND_PERSON = r"\byou\b|\byour\b|\byours\b|\byourself\b|\byoure\b|\byou're\b|\bu r\b|\bur\b"
ADDRESSING = (
    r"\bwhat an?\b|\bwhat kind of\b|\bonly an? [^.!?]{0,60} would\b|\bhey\b|\bnobody asked\b|\bis an? (?:complete|total|utter)\b|\bthis author\b|\bthat so-called\b|\bwhoever screened\b|\bthis (?:idiot|moron|clown)\b|\bcalling (?:you|him|her)\b|\bsuch an? \b|\bthe opinion of\b|\blisten\b|^[^a-z]*[^,]{0,40}, (?:and|learn|read)"
)
# What marks a passage as one that studies or reports.
STUDY = (
    r"\b(?:participants?|respondents?|adults?|pupils?|classmates|coders?|items?|scales?|outcomes?|studies|study|screening|measured|reported|self-reported|coded|agreement|classifiers?|loading|counted|interviewed|clinician|nurse explained|explained by|offered to|"
    r"posts?|hate speech|prejudice|abuse|bullying|education|consent|weeks|weekly|housed|humanely|dislocation|nest|nests|market|outcome|predictor|condom|erectile|intercourse|cancer|breast examination|thoughts|followed up|complaint|removed|quoted|quotes?|interviews?|survey\w*|sample of|enrolled|randomi[sz]ed|data|terminal|switch|script|imputation|rose by|was a threat|were asked|was asked|asks how)\b"
)


def _words_alternation(words: list[str]) -> str:
    return r"\b(?:" + "|".join(sorted(map(re.escape, words), key=len, reverse=True)) + r")\b"


#: Words whose hiding is likely: they raise the language model and are words for the decoder.
HIDDEN_WORDS = sorted(
    set(INSULTS)
    | set(
        "fuck fucking fucked fucker fucks shit shitty ass arse tits cock dick pussy cunt porn sex naked nude nudes hard horny naked die died dying kill killed killing rot yourself stupid dirty filthy vermin rats disease subhuman ugly fat idiot pathetic worthless braindead "
        "brainless spineless disgusting talentless hack liar pig cow ape goat rat shut hell mouth slap beat hate lick licking scream breasts bare hot wet live cam pills cage drown criminals lazy clown crybaby toad garbage human waste skin stain sack trash "
        "smelly wretched drooling hopeless break fingers regret mierda basura gilipollas imbécil gueule ordure vermine fresse dreck vollidiot verpiss ungeziefer plaga"
        .split()
    )
)


_INSULT = re.compile(_words_alternation(INSULTS) + "|" + "|".join(INSULT_PHRASES))
_STRONG = re.compile(rf"\b(?:{STRONG})\b")
_GROUP = re.compile(rf"\b(?:{GROUPS})\b")
_DEHUMAN = re.compile(rf"(?:{DEHUMANISING})")
_THREAT = re.compile(rf"\b(?:{THREATS})\b")
_SEX = re.compile(rf"\b(?:{SEX_ACTS})\b")
_TRADE = re.compile(rf"\b(?:{SEX_TRADE})\b")
_SECOND, _ADDRESS, _STUDY = re.compile(SECOND_PERSON), re.compile(ADDRESSING), re.compile(STUDY)
_OTHER = re.compile("|".join(rf"(?<!\w)(?:{x})" if x[0] not in "(死くバ馬クゴキ消殺ぶ間" else x for x in OTHER_ABUSE))
_OTHER_HATE = re.compile("|".join(OTHER_HATE))
_QUOTED = re.compile(r"“[^”]{0,400}”|„[^“”]{0,400}[“”]|«[^»]{0,400}»|\"[^\"\n]{0,400}\"|「[^」]{0,400}」|‘[^’\n]{0,200}’(?!\w)")
_LEAD = re.compile(r"^\s*(?:>+|[-*•]|re:|@\w+|lol|haha)+\s*", re.I)


def seed_label(passage: str) -> dict[str, float]:
    """How sure the seeds are that a restored passage is abuse, hate or sexual content, each from 0 to 1."""
    p = _LEAD.sub("", passage)
    own = _QUOTED.sub(" ", p)
    study = len({m[0] for m in _STUDY.finditer(own)})
    if own.strip(" .") == "" or len(own) < len(p) * 0.25:
        return {"abuse": 0.0, "hate": 0.0, "sexual": 0.0}
    quoting = own != p
    second = bool(_SECOND.search(own))
    address = bool(_ADDRESS.search(own))
    insults, strong, threats = (len(x.findall(own)) for x in (_INSULT, _STRONG, _THREAT))
    groups, dehuman = (len(x.findall(own)) for x in (_GROUP, _DEHUMAN))
    sex, trade = (len(x.findall(own)) for x in (_SEX, _TRADE))
    # Words of study count half where somebody is addressed.
    damp = (1.0 if second or address else 2.0) * min(study, 3) + 1.5 * quoting
    abuse = -4.0 - damp + (5.5 if insults and (second or address) else 2.0 * min(insults, 2)) + (5.5 if strong and (second or address) else 2.0 * min(strong, 1)) + (6.0 if threats else 0.0) + (1.5 if second and (insults + threats) else 0.0)
    if _OTHER.search(own):
        abuse += 7.0
    hate = -4.5 - damp + (4.5 * min(groups, 1) * min(dehuman, 1)) * 1.3 + 1.0 * min(max(dehuman - 1, 0), 2) + (1.0 if groups and insults else 0.0)
    if dehuman and not groups and re.search(r"\b(?:them|they|their)\b", own) and re.search(r"put them down|subhuman|vermin|sick dogs|beat them|lock them|exterminat", own):
        hate += 6.0
    if _OTHER_HATE.search(own):
        hate += 7.0
    sexual = -4.0 - damp + 5.5 * min(sex, 1) + 1.5 * min(max(sex - 1, 0), 2) + 4.2 * min(trade, 1) + 2.0 * min(max(trade - 1, 0), 2) + (1.5 if strong and sex else 0.0)
    return {k: 1 / (1 + math.exp(-v)) for k, v in (("abuse", abuse), ("hate", hate), ("sexual", sexual))}


# Words of the generated seed sentences.
HARM = "kill/killed hurt/hurt burn/burned shoot/shot stab/stabbed beat/beaten hang/hanged gas/gassed drown/drowned strangle/strangled smash/smashed crush/crushed torture/tortured slaughter/slaughtered poison/poisoned rape/raped cut/cut break/broken choke/choked destroy/destroyed bury/buried"
OWN = "you/your family/your children/your kids/your wife/your mother/your house/your home/your face/your legs/you and your family/you in your sleep/your dog"
PEOPLE = "those people/these people/people like them/migrants/refugees/immigrants/foreigners/women/muslims/jews/christians/gay people/the disabled/old people/the poor/gypsies/blacks/asians/people from that country/people of that faith/their kind/that tribe"
LOW = "scum/vermin/rats/parasites/animals/filth/garbage/trash/cockroaches/dirt/subhuman/inferior/a plague/a disease/a cancer/worthless/savages/dogs/swine/criminals by nature/thieves by birth"
NAME = "idiot/moron/imbecile/cretin/scum/loser/pig/rat/worm/bastard/fool/dog/parasite/clown/coward/disgrace/waste of air/piece of dirt/piece of filth/sorry excuse for a human being"
SEXUAL = "i want you naked in my bed tonight/come to my room and undress/send me pictures of your naked body/i want to lick your body/let me touch your breasts/i dream of your naked body on top of me/she moaned as he pushed deeper into her/he took her against the wall until she screamed/watch hot naked girls live on cam/horny singles want to meet you tonight/free porn videos and live sex chat/bend over and let me do you"
CALM_VERB = "invite/invited survey/surveyed include/included interview/interviewed contact/contacted follow/followed assess/assessed screen/screened support/supported train/trained recruit/recruited describe/described review/reviewed compare/compared"
CALM_OWN = "your manuscript/your comments/your review/your abstract/the reviewers/your study/the second sample/your proposal/your extraction sheet/the protocol/your librarian/your team"
CALM_SAYING = "at higher risk of falls/more likely to reply/part of the sample/less often included in trials/the target population/older on average/eligible for the study/underrepresented in research/interviewed at home/satisfied with care"


def seed_sentences(n: int = 6000, seed: int = 17) -> list[tuple[str, dict[str, float]]]:
    """Generated sentences with labels, half of them calm ones of the same build."""
    rnd = random.Random(seed)
    harm, calm = ([tuple(x.split("/")) for x in t.split()] for t in (HARM, CALM_VERB))
    own, people, low, name, sexual, calm_own, saying = (t.split("/") for t in (OWN, PEOPLE, LOW, NAME, SEXUAL, CALM_OWN, CALM_SAYING))
    none = {"abuse": 0.0, "hate": 0.0, "sexual": 0.0}
    out: list[tuple[str, dict[str, float]]] = []
    pick = rnd.choice
    when = ("", " tonight", " tomorrow", " soon", " one day", " this week", " next time")
    by = ("", " by birth", " by nature", " from birth", " and always will be")
    for _ in range(n // 8):
        v, c = pick(harm), pick(calm)
        modal, sub = pick(("will", "am going to", "would love to", "want to")), pick(("somebody ought to", "someone should", "they should", "we will", "i hope they", "i hope someone will"))
        out += [
            (f"i {modal} {v[0]} {pick(own)}{pick(when)}.", none | {"abuse": 1.0}),
            (f"{sub} {v[0]} {pick(own)}{pick((' down', '', ' with you in it', ' and laugh'))}{pick(when)}.", none | {"abuse": 1.0}),
            (f"{pick(people)} {pick(('should', 'must', 'ought to', 'need to'))} {pick(('all ', '', 'just '))}be {v[1]}.", none | {"hate": 1.0}),
            (f"{pick(people)} are {pick(('', 'all ', 'nothing but ', 'just '))}{pick(low)}{pick(by)}.", none | {"hate": 1.0}),
            (f"{pick(('you are a', 'you are such a', 'what a', 'you', 'he is a complete', 'only a'))} {pick(('', 'stupid ', 'filthy ', 'worthless ', 'pathetic ', 'dirty '))}{pick(name)}{pick(('', ' and everyone knows it', ', get lost', ', go away'))}.", none | {"abuse": 1.0}),
            (f"{pick(sexual)}{pick(when)}.", none | {"sexual": 1.0}),
            (f"{pick(('we', 'i', 'the authors', 'they'))} {pick(('will', 'are going to', 'would like to', 'want to', 'should'))} {c[0]} {pick(calm_own)}{pick(when)}.", none),
            (f"{pick(people)} {pick(('should', 'must', 'were to', 'need to'))} {pick(('all ', '', 'also '))}be {c[1]}.", none),
            (f"{pick(people)} are {pick(('', 'often ', 'mostly ', 'not '))}{pick(saying)}.", none),
            (f"{pick(('the participants', 'the mice', 'two of the patients', 'the respondents', 'the pupils'))} were {pick((v[1], c[1]))} {pick(('in the study', 'after four weeks', 'at baseline', 'in the second trial', 'as reported'))}.", none),
            (f"{pick(('the item asks whether', 'the study measured how often', 'respondents reported that', 'the survey asked if'))} {pick(('someone had', 'others', 'classmates'))} {pick((v[1], 'called them a ' + pick(name), 'said they are ' + pick(low)))}.", none),
            (f"{pick(('this', 'the'))} {pick(('paper', 'analysis', 'review', 'draft', 'argument'))} is {pick(('weak', 'a mess', 'nonsense', 'wrong', 'useless for our question', 'badly written'))}{pick(('', ', frankly', ' and should be rejected', ' and you should start again'))}.", none),
        ]
    return out


def _spell_out(parsed: object, rnd: random.Random) -> str:
    """A text that a parsed pattern matches, or nearly: optional parts at random, word characters left out."""
    out = ""
    for op, arg in parsed:
        if op is _parser.LITERAL:
            out += chr(arg)
        elif op is _parser.IN:
            out += next((chr(x) for o, x in arg if o is _parser.LITERAL), "")
        elif op is _parser.SUBPATTERN:
            out += _spell_out(arg[3], rnd)
        elif op is _parser.BRANCH:
            out += _spell_out(rnd.choice(arg[1]), rnd)
        elif op in (_parser.MAX_REPEAT, _parser.MIN_REPEAT):
            out += _spell_out(arg[2], rnd) * max(arg[0], rnd.randrange(2))
    return out


def pattern_sentences(n: int = 3000, seed: int = 23) -> list[tuple[str, dict[str, float]]]:
    """Sentences spelled out from the seed patterns, in simple frames, with the labels that the patterns give them."""
    rnd = random.Random(seed)
    parsed = {name: _parser.parse(p.pattern) for name, p in (("insult", _INSULT), ("strong", _STRONG), ("group", _GROUP), ("low", _DEHUMAN), ("threat", _THREAT), ("sex", _SEX), ("trade", _TRADE), ("other", _OTHER), ("other_hate", _OTHER_HATE))}
    say = lambda name: _spell_out(parsed[name], rnd)
    frames = (
        lambda: f"you {say('insult')}.", lambda: f"what a {say('insult')}, learn to read.", lambda: f"you are a {say('insult')} and a {say('insult')}.", lambda: f"{say('strong')} you and your study.", lambda: f"you {say('strong')}.",
        lambda: f"{say('threat')}.", lambda: f"{say('threat')} you {say('insult')}.", lambda: f"i will {say('threat')}.", lambda: f"{say('group')} are {say('low')}.", lambda: f"{say('group')} should be {say('low')}.", lambda: f"every time i see {say('group')} i {say('low')}.",
        lambda: f"{say('sex')}.", lambda: f"{say('sex')} {say('sex')}.", lambda: f"{say('trade')} {say('trade')}.", lambda: f"{say('other')}.", lambda: f"{say('other')} {say('other')}.", lambda: f"{say('other_hate')}.",
    )
    out = []
    for k in range(n):
        text = " ".join(frames[k % len(frames)]().split()).lower()
        label = seed_label(text)
        if max(label.values()) >= 0.5:
            out.append((text, label))
    return out
