"""Word lists.  Small ones are stated here; larger ones are parameters with a small default."""

from __future__ import annotations

# Names of months in French, English and Arabic.
MONTHS = (
    "janvier fevrier février mars avril mai juin juillet aout août septembre octobre novembre decembre décembre "
    "january february march april may june july august september october november december "
    "يناير فبراير مارس أبريل مايو يونيو يوليو غشت شتنبر أكتوبر نونبر دجنبر"
).split()
# Words of institutions, which are no recipients of a paper.
INSTITUTIONS = "société centre ministère université école institut".split()
# Words of section headings, compared in capitals.
HEADINGS = "CURRICULUM VITAE DONNEES PERSONNELS PROFIL CONTACT RESUME FORMATION COMPETENCES EXPERIENCE LANGUES FIGURE".split()
# First words of lines that name recognition skips.
SECTIONS = "formation experiences expérience competences compétence langues".split()
# Place names that precede a name at the top of an Arabic page.
PLACES = "المغرب|المملكة المغربية|الدار البيضاء|الرباط|سلا|فاس|طنجة|مكناس|أكادير|تطوان|وجدة|القنيطرة"
# Forms of address.
HONORIFICS = r"M\.|Mme|Mlle|Monsieur|Madame|Dr\.?|Mr\.?"
# Default of a parameter: professional words that are never names.  Callers pass their own full list (``word_list``).
STOPWORDS = (
    "profil profile resume curriculum vitae formation competences compétences experience expérience skills education langues languages "
    "responsable developpeur développeur technicien technicienne ingenieur ingénieur manager engineer developer architect cloud data "
    "projet project maintenance logistique warehouse planner certificat attestation diplome diplôme master licence bachelor stage"
).split()
# Given names, which alone never identify a person (with forms of kings' names).
GIVEN_NAMES = (
    "mohammed mohamed mohammad ahmed youssef yousef ali hassan houssam amine mehdi hamza omar othman khalid tarik tariq anas "
    "karim morad mourad mustapha mostafa adil said rachid rachida fatima khadija salma sara sarah iman imane meriem meryem "
    "soukaina asmaa asma chaimae chaima nouhaila zineb nassima laila doha soufyane soufiane rachad madiha yassine samir "
    "abdellah abdallah abdelaziz abdelkader abderrahim abdelali hicham nabil jamal driss idriss faycal faysal anwar anouar "
    "safaa hanaa wafa wafaa kaoutar kawtar ghita loubna bouchra mona mouna najlae najwa hanane ihsane mariam marwa hajar "
    "jean pierre michel paul marie alain philippe nicolas alexandre thomas laurent julien david antoine stephane "
    "john michael james robert william mary "
    "محمد أحمد يوسف علي حسن أمين مهدي حمزة عمر عثمان خالد طارق أنس كريم مراد مصطفى عادل سعيد رشيد رشيدة "
    "فاطمة خديجة سلمى سارة إيمان مريم سكينة أسماء شيماء نهيلة زينب نسيمة ليلى ضحى سفيان رشاد مديحة ياسين سمير "
    "عبد عبدالله عبدالعزيز عبدالرحمن عبدالرحيم عبدالكريم هشام نبيل جمال إدريس فيصل "
    "أنور صفاء هناء وفاء كوثر غيثة لبنى بشرى منى نجلاء نجوى حنان إحسان مروة هاجر الخامس الأول الثاني"
).split()
# Arabic first names of the gazetteer.
ARABIC_FIRST_NAMES = (
    "محمد احمد أحمد إبراهيم ابراهيم محمود علي حسن حسين عمر عمرو خالد طارق يوسف مصطفى كريم ياسين حمزة "
    "سعيد هشام وليد رشيد عادل سامي أيمن ايمن زياد فاطمة مريم سارة خديجة عائشة نور ياسمين زينب هدى "
    "منى آية اية أسماء اسماء أمينة امينة صفاء شيماء سلمى ليلى سميرة حنان وفاء سناء جمال سمير كمال "
    "بلال انس أنس يونس سفيان عبدالله عبدالرحمن عبدالعزيز صلاح مهدي نبيل فؤاد"
).split()
# Arabic titles before a name, labels before one, and first parts of compound names.
ARABIC_TITLES = "السيد|السيدة|الآنسة|الأستاذ|الاستاذ|الأستاذة|الاستاذة|الدكتور|الدكتورة|المهندس|المهندسة|المحامي|المحامية|الباحث|الباحثة"
ARABIC_LABELS = r"الاسم(?:\s+الكامل)?|المرشح|صاحب السيرة"
ARABIC_ABD = "الله|الرحمن|الرحيم|العزيز|المجيد|الملك|الكريم|الواحد|الفتاح|الخالق|الرزاق|اللطيف|العليم|الحليم|الحكيم|الشكور|الحميد|القدوس|السلام|المؤمن|المهيمن|الجبار|المتكبر"
ARABIC_DIN = "نور|شمس|سيف|صلاح|علاء|عماد|جمال|بهاء|ضياء|حسام|كمال"
# Function words by which the language of Latin text is told.
FUNCTION_WORDS = {
    "fr": "le la les des et est une dans pour avec sur par du au que qui".split(),
    "en": "the of and to in is for with on that by from was are at".split(),
    "es": "el la los las y en una para con por del que se al es".split(),
    "de": "der die das und ist ein eine mit für von im auf den dem nicht".split(),
}


def word_list(path: str) -> list[str]:
    """Words of a text file, one a line, for the parameters above; blank lines and lines with # do not count."""
    with open(path, encoding="utf-8") as f:
        return [w for line in f if (w := line.strip()) and w[0] != "#"]
