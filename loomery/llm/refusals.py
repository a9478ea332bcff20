"""Refusals in any of two dozen languages: what a sentence says, word by word, is aligned with general forms of refusing."""

from __future__ import annotations

import functools
import re
import unicodedata

#: What a word of a refusal does, one letter for each role.
SORRY, DENY, OWN_DENY, REFUSE, MODAL, NOT, TASK, REQUEST, MODEL, SELF, SAID = "SDPRMNTQAIV"

# Words of each role by language, "|" between words. A word of a spaced script stands for all words that
# begin with it; one with a closing "." stands for itself alone.
WORDS = {
    SORRY: """抱歉|对不起|不好意思|遗憾|见谅|谅解|体谅|原谅|可惜|谢谢您|感谢您|谢谢你|感谢你|您理解
        sorry|apolog|unfortunately|regret|afraid|forgive|lo siento|lament|perdón|perdon|disculp|me temo|por desgracia|desafortunadamente
        désolé|regrette|malheureusement|excuse|pardon|navré|tut mir leid|leider|entschuldig|bedau|verzeih|mi dispiace|spiacente|purtroppo|scus|mi spiace
        desculp|infelizmente|sinto muito|sinto.|perdão|helaas|spijt me|tyvärr|förlåt|ledsen|beklag|desværre|dessverre|undskyld|unnskyld|przeprasz|przykro|niestety
        omlouv|bohužel|lituji|îmi pare rău|din păcate|scuze|üzgünüm|maalesef|özür|kusura|извин|простите|сожалени|сожалею|жаль|прощения|вибачте|шкода|перепрош|жаль
        λυπάμαι|συγγνώμη|δυστυχώς|آسف|أعتذر|اعتذر|عذر|للأسف|المعذرة|يؤسفني|متأسف|متاسف|ببخشید|מצטער|סליחה|לצערי|क्षमा|माफ|खेद|दुर्भाग्य
        maaf|sayangnya|xin lỗi|rất tiếc|ขอโทษ|ขออภัย|เสียใจ|申し訳|すみません|恐れ入り|残念|ごめん|恐縮|죄송|미안|유감|안타깝""",
    DENY: """无法|不能|没有办法|没办法|没法|做不到|做不了|办不到|不便|不方便|不予|不作|不做|不会|不支持|没有权限|无权|没有资格|不具备|不宜|不可以|不适合|超出|超越|不在|不属于|不提供|不打算|不愿|不想
        选择不|难以|不接受|不允许|没有能力|没有把握|不合适
        cannot|cant.|can not|unable|not able|wont.|will not|not allowed|not permitted|not going to|couldnt|could not|outside|beyond|not possible|impossible|not comfortable|not in a position|not authori|not something|not appropriate""",
    OWN_DENY: """no puedo|no podemos|no podré|no me es posible|no soy capaz|no es posible|no estoy autorizad|no me está permitido|no debo|no voy a|ne peux|ne pouvons|ne suis pas en mesure|ne mest pas possible|ne saurais|ne pourrai|ne suis pas autorisé|ne vais pas|il mest impossible
        non posso|non possiamo|non sono in grado|non mi è possibile|non è possibile|non riesco|não posso|não podemos|não consigo|não sou capaz|não é possível|não estou autorizad|não me é possível|não vou|não poderei
        nie mogę|nie możemy|nie jestem w stanie|nie potrafię|nie wolno mi|nie da się|nie będę|nemohu|nemůžu|nejsem schop|nu pot.|nu putem|nu sunt în măsură|не могу|не можем|не смогу|не в состоянии|не имею права|не буду|не получится|не можу|не можемо|не зможу|не в змозі
        δεν μπορώ|δεν μπορούμε|αδυνατώ|δεν είναι δυνατ|لا أستطيع|لا استطيع|لا يمكنني|لا أقدر|لن أتمكن|لن أستطيع|غير قادر|لست قادر|لا يسعني|ليس بإمكاني|ليس بوسعي|نمی توانم|نمیتوانم|قادر نیستم|לא יכול|אין באפשרותי|איני יכול
        असमर्थ|नहीं कर सक|नहीं दे सक|नहीं सक|tidak dapat|tidak bisa|tak bisa|tidak mampu|tidak boleh|không thể|không được phép|ไม่สามารถ
        できません|できかね|いたしかね|致しかね|出来ません|出来かね|かねます|られません|えません|差し上げられ|수없|못합니다|못해|못하|어렵습니다|드리기어렵|불가능""",
    REFUSE: """拒绝|婉拒|谢绝|恕我|恕难|恕不|从命|跳过|帮不上|爱莫能助|无可奉告|无能为力
        decline|refuse|rechaz|me niego|declin|décline|ablehn|verweiger|lehne.|rifiut|recus|odmawiam|odmówić|отказываюсь|отказать|відмовля|reddet|reddedi|أرفض|お断り|断りします|遠慮|辞退|거절|거부|từ chối|menolak|weiger|αρνούμαι|αρνηθώ|avböj|odmítám|odmítnout|refuz|ปฏิเสธ|מסרב|अस्वीकार""",
    MODAL: "kann.|können|könnte|darf|dürfen|möchte|kan.|kunnen|mag.|kommer",
    NOT: "nicht.|niet.|inte.|ikke.|kein",
    TASK: """改写|简化|简写|缩写|回答|答复|翻译|总结|概括|生成|协助|帮助|帮忙|帮您|帮你|完成|提供|给出|处理|满足|答应|办理|评论|讨论|执行|修改|润色
        help|assist|rewrit|simplif|shorten|summar|answer|respon|comply|fulfil|provide|produce|process|complet|generat|paraphras|translat|rephras|do that|do this|do so|support|engage|proceed|discuss|share.|write|accommodate|handle|offer
        ayud|responder|reescrib|simplific|cumplir|procesar|atender|proporcion|contestar|resum|aider|répondre|réécri|simplifi|traiter|fournir|satisfaire|reformul|helfen|weiterhelfen|behilflich|beantwort|umschreib|vereinfach|bearbeit|unterstütz|erfüllen|liefern|umformulier|zusammenfass|hilfe
        aiutar|rispond|riscriv|semplific|elabor|fornir|soddisf|assist|riformul|ajud|respond|reescrev|process|fornec|auxili|reformular|helpen|beantwoord|vereenvoud|herschrij|hjälpa|svara|skriva om|hjelpe|hjælpe|besvare
        pomóc|pomoc|odpowied|przepis|uprość|uprościć|spełnić|wykonać|przetworz|udzielić|pomoci|odpověd|přeps|zjednoduš|ajuta|răspund|rescri|yardım|yanıt|cevap|yeniden yaz|sadeleştir|yerine getir|işle
        помоч|помога|ответ|выполн|упрост|перепис|обработ|предостав|допомог|відповіс|викона|βοηθήσ|απαντήσ|مساعد|أساعد|الإجابة|اجابة|إعادة صياغة|صياغة|تبسيط|تلبية|تنفيذ|الرد|معالجة|تقديم|کمک|پاسخ|לעזור|לענות|सहायता|मदद|उत्तर
        membantu|menjawab|memproses|menulis ulang|giúp|trả lời|viết lại|hỗ trợ|ช่วย|ตอบ|お手伝い|回答|書き換え|書き直|要約|対応|お答え|応じ|提供|処理|簡略|お力|도와|도움|도울|답변|수정|처리|제공|응답|요약|작성""",
    REQUEST: """这段|这一段|这类|此类|该内容|该请求|您的请求|你的请求|这个请求|这项请求|此请求|这个问题|该问题|此问题|这个要求|您的要求|你的要求|该要求|这项任务|该任务|这个任务|这篇|您要的|你要的|您的需求|你的需求|这些内容|这份|这种内容|这件事|此事|相关请求|以上内容|上述内容|这样的
        this request|your request|that request|the request|this passage|this text|this content|this question|your question|that question|the text you|the passage|this task|that task|you asked|you provided|you sent|you want|what youre asking|this material|with this|with that|this one|for you.
        esta solicitud|su solicitud|tu solicitud|este texto|esta petición|su petición|tu petición|este contenido|esta pregunta|su pregunta|con esto|con eso|cette demande|votre demande|ta demande|ce texte|ce contenu|cette question|votre question|cette requête|ce passage
        anfrage|diesen text|diese bitte|dieser bitte|diese frage|ihre frage|diesem wunsch|ihren wunsch|diesen inhalt|damit.|dabei.|questa richiesta|tua richiesta|sua richiesta|questo testo|questa domanda|questo contenuto|questo brano
        este pedido|esse pedido|seu pedido|esta solicitação|essa solicitação|sua solicitação|esta pergunta|essa pergunta|esse texto|este trecho|dit verzoek|uw verzoek|deze tekst|deze vraag|hiermee|denna begäran|den här texten|denne teksten|denne forespørsel|detta.
        prośb|tego tekstu|ten tekst|to pytanie|na pytanie|tego fragmentu|w tym.|této žádost|tento text|această solicitare|această cerere|acest text|этот запрос|ваш запрос|этот текст|этого текста|эту просьбу|вашу просьбу|этот вопрос|с этим|этого запроса|вашего запроса|цей запит|ваш запит|цей текст
        αίτημα|αυτό το κείμενο|bu isteğ|bu taleb|bu metni|bu soruya|isteğiniz|talebiniz|bu konuda|bu metin|هذا الطلب|طلبك|لطلبك|هذا النص|هذا السؤال|سؤالك|هذا المحتوى|این درخواست|درخواست|בבקשה הזו|הבקשה|הטקסט|इस अनुरोध|अनुरोध|इस पाठ|permintaan|teks ini|yêu cầu|văn bản này|คำขอ|ข้อความนี้
        リクエスト|ご依頼|ご要望|この文章|この質問|ご質問|この内容|この依頼|こちらの|この文|요청|이글|이질문|이텍스트|이내용|이문장|해당내용""",
    MODEL: """语言模型|人工智能|智能助手|文字助手|写作助手|助手|机器人|as an ai|language model|ai assistant|ai model|as an assistant|chatbot|modelo de lengua|inteligencia artificial|asistente|modèle de langage|intelligence artificielle|assistant|sprachmodell|als ki.|assistent
        modello linguistico|intelligenza artificiale|assistente|modelo de linguagem|inteligência artificial|taalmodel|språkmodell|model językow|sztuczna inteligencja|asystent|jazykový model|языковая модель|искусственный интеллект|ассистент|мовна модель|γλωσσικό μοντέλο|yapay zeka|dil modeli|asistan
        نموذج لغ|ذكاء اصطناعي|الذكاء الاصطناعي|مدل زبانی|מודל שפה|भाषा मॉडल|model bahasa|kecerdasan buatan|asisten|mô hình ngôn ngữ|trí tuệ nhân tạo|trợ lý|แบบจำลองภาษา|言語モデル|アシスタント|언어모델|인공지능|어시스턴트""",
    SELF: "我|本人|这边|咱|i.|im.|ill.|ive.|we.|me.|私|저는|제가|ich.|wir.|mir.|ik.|wij.|jag.|jeg.",
    SAID: "表示|回复|答复说|说道|回应|声称|宣布|指出|强调|反映|他说|她说|会说|曾说|said|replied|told|respond|announced|explained|wrote|states|stated|answered|dijo|respondió|a dit|a répondu|sagte|antwortete|ha detto|disse|сказал|ответил|と述べ|と言っ|と答え|라고말|라고답",
}
# Traditional characters in words of refusals, and their simplified ones.
SIMPLE = str.maketrans(
    "無對沒辦這請為簡寫內處類問題權據規範務圍協專業絕從給諒釋謝敏們個時語資實願幫遺憾體會難適選擇應該項機譯總結過邊執讓見產當樣還顧滿評論討續潤縮達",
    "无对没办这请为简写内处类问题权据规范务围协专业绝从给谅释谢敏们个时语资实愿帮遗憾体会难适选择应该项机译总结过边执让见产当样还顾满评论讨续润缩达",
)

#: The forms: a sentence refuses if one of them is a subsequence of its words' roles.
FORMS = (
    "SDT", "SDQ", "STD", "SQD", "DTS", "DQS", "QDS", "TDS", "SID", "IDT", "IDQ", "IQD", "QID", "TID", "QDT", "QDI", "ADT", "ADQ", "AID", "QDQ",
    "SP", "PS", "PT", "TP", "PQ", "QP", "AP", "SR", "RS", "IR", "RI", "AR", "QR", "RQ", "RT", "SMN", "MSN", "MNT", "QMN", "MQN", "AMN",
)
_SPLIT = re.compile(r"(?<=[。！？!?；;\n])|(?<=\.)(?=\s|\Z)")
_HEAD = re.compile(r"[^：:]+[：:](?=.)", re.S)
QUOTED = re.compile(r"“[^”]*”|\"[^\"\n]*\"|「[^」]*」|『[^』]*』|«[^»]*»|„[^“”]*[“”]")
_APOSTROPHE = re.compile(r"['’`´]")
_OTHER = re.compile(r"[\W_]+")


def _dense(c: str) -> bool:
    """Scripts written without blanks, and Hangul, whose blanks vary."""
    o = ord(c)
    return 0x2E80 <= o <= 0x9FFF or 0xAC00 <= o <= 0xD7AF or 0x0E00 <= o <= 0x0E7F or o >= 0x20000


@functools.cache
def _words():
    """Two automata: words of dense scripts, and words of spaced ones with a blank before."""
    import ahocorasick

    dense, spaced = ahocorasick.Automaton(), ahocorasick.Automaton()
    for role, text in WORDS.items():
        for w in (x.strip() for line in text.split("\n") for x in line.split("|")):
            if not w:
                continue
            if _dense(w[-1]) or _dense(w[0]):
                key, to = w, dense
            else:
                key, to = " " + (w[:-1] + " " if w.endswith(".") else w), spaced
            old = to.get(key, ("", 0))[0]
            to.add_word(key, (old + role, len(key)))
    dense.make_automaton()
    spaced.make_automaton()
    return dense, spaced


# Endings of Turkish verbs for what the speaker cannot do.
_TURKISH = re.compile(r"\w[ae](?:mam|mem|mıyorum|miyorum|mayacağı|meyeceği|mıyoruz|miyoruz|mayız|meyiz)\w*")


def roles(sentence: str) -> str:
    """The roles of a sentence's words in their order."""
    text = unicodedata.normalize("NFKC", sentence).lower().translate(SIMPLE)
    text = " " + _OTHER.sub(" ", _APOSTROPHE.sub("", text)) + " "
    dense, spaced = _words()
    found = []
    if not text.isascii():
        place = [i for i, c in enumerate(text) if c != " "]
        found += [(place[end + 1 - n], -n, r, place[end] + 1) for end, (r, n) in dense.iter(text.replace(" ", ""))]
        found += [(m.start(), 0, OWN_DENY, m.end()) for m in _TURKISH.finditer(text)]
    found += [(end + 1 - n, -n, r, end) for end, (r, n) in spaced.iter(text)]
    out, reach = [], -1
    for at, n, r, end in sorted(found):  # of words inside one another the longest
        if end > reach:
            out.append(r)
            reach = end
    return "".join(out)


def is_form(found: str) -> bool:
    """Whether the roles align with a form, and nobody else is reported to have said so."""
    if not any(c in found for c in (DENY, OWN_DENY, REFUSE, NOT)):
        return False
    said = found.find(SAID)
    if said >= 0 and SELF not in found[:said] and SORRY not in found[:said] and MODEL not in found[:said]:
        return False
    return any(aligned(f, found) for f in FORMS)


def aligned(form: str, found: str) -> bool:
    """The form is their longest common subsequence."""
    at = -1
    for c in form:
        at = found.find(c, at + 1)
        if at < 0:
            return False
    return True


def sentences(text: str) -> list[str]:
    """Sentences, and what stands before the first colon of each; one that only apologizes stands with the next as well."""
    own = [x for x in _SPLIT.split(text) if x and x.strip()]
    heads = [m[0] for m in map(_HEAD.match, own) if m]
    return own + heads + [a + b for a, b in zip(own, own[1:]) if len(a.strip()) <= 40 and SORRY in (r := roles(a)) and not set(r) - {SORRY, SELF, MODEL}]


def _shingles(text: str, k: int) -> set[str]:
    return {text[i : i + k] for i in range(len(text) - k + 1)}


def is_refusal(source: str | None, target: str) -> bool:
    """A sentence of the target declines, and says little of the source.

    Words in quotation marks are what others said, unless nothing else is there. Texts of any length are read whole.
    """
    body = QUOTED.sub(" ", target)
    if not _OTHER.sub("", body):
        body = target
    found = [s for s in sentences(body) if is_form(roles(s))]
    if not found:
        return False
    of = _OTHER.sub("", source.lower()) if source else ""
    shingles: dict[int, set[str]] = {}
    for s in found:
        plain = _OTHER.sub("", s.lower())
        k = 8 if sum("a" <= c <= "z" for c in plain) > len(plain) / 2 else 4
        if k not in shingles:
            shingles[k] = _shingles(of, k)
        own = _shingles(plain, k)
        if not own or len(own & shingles[k]) <= 0.4 * len(own):
            return True
    return False
