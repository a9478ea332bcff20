"""Refusals and proper answers that no list of the code holds."""

import pytest

from loomery.llm import refusals

SOURCE_ZH = "由于客流持续增加的缘故，编号Za-847的终端目前暂时无法正常完成对桥梁支座的识别操作。"
SOURCE_EN = "The council announced on Tuesday that the night buses will no longer be able to serve the northern district because of repairs to the bridge."

REFUSALS = {
    "zh": [
        "实在对不住，这类内容我没有能力进行改写。", "很遗憾，您提出的这个请求我这边没法处理。", "感谢您的提问，但这个问题我不方便作答，望您谅解，无法提供结果。", "我是一个人工智能助手，无法对此类材料给出简写。", "抱歉呢，这段话我处理不了，也不能翻译。",
        "这项任务我不能完成。", "对不起，我不会生成这样的内容。", "恕我直言，该请求我不能满足。", "不好意思哈，这篇文章我没办法帮您总结。", "請原諒，這段文字我無法替您改寫。", "非常抱歉，我不能繼續處理您的請求。", "我只能婉拒您的要求。",
    ],
    "en": [
        "Sorry, I'm not able to rewrite that for you.", "I must respectfully decline to answer this question.", "I'm afraid I can't do that.", "As a language model, I cannot provide a simplified version of this.", "Regrettably, I will not be able to assist with your request.",
        "My apologies, but this request is outside what I'm allowed to do, so I can't comply.", "I'm unable to process this text.", "I do apologise. I am not comfortable rewriting this passage.", "Unfortunately I could not complete that task for you.", "I refuse to answer this question.",
    ],
    "es": ["Lo lamento, pero no puedo ayudarte con esta solicitud.", "Lamentablemente no me es posible simplificar este texto.", "Como modelo de lenguaje, no puedo responder a eso.", "Disculpe, no estoy autorizado para procesar su petición.", "Me niego a contestar esta pregunta.", "No puedo proporcionar una versión más corta de este contenido."],
    "fr": ["Je suis navré, je ne peux pas traiter votre demande.", "Malheureusement, je ne suis pas en mesure de simplifier ce texte.", "En tant que modèle de langage, je ne peux pas répondre.", "Je regrette, il m'est impossible de vous aider.", "Veuillez m'excuser, mais je ne saurais reformuler ce passage.", "Je refuse de répondre à cette question."],
    "de": ["Es tut mir leid, dabei kann ich Ihnen nicht helfen.", "Leider kann ich diese Anfrage nicht bearbeiten.", "Als Sprachmodell darf ich diesen Text nicht umschreiben.", "Entschuldigung, ich kann diese Frage nicht beantworten.", "Ich bedaure, aber diesen Wunsch kann ich nicht erfüllen.", "Ich muss diese Anfrage leider ablehnen."],
    "it": ["Mi dispiace, non posso aiutarti con questa richiesta.", "Purtroppo non sono in grado di riscrivere questo testo.", "In quanto modello linguistico, non posso rispondere a questa domanda.", "Spiacente, ma non mi è possibile semplificare il brano.", "Devo rifiutare la tua richiesta."],
    "pt": ["Desculpe, mas não posso ajudar com este pedido.", "Infelizmente, não consigo simplificar este texto.", "Sinto muito, não estou autorizado a responder a essa pergunta.", "Como modelo de linguagem, não posso atender à sua solicitação.", "Lamento, não me é possível reescrever isto."],
    "ru": ["К сожалению, я не могу выполнить этот запрос.", "Извините, но я не в состоянии упростить этот текст.", "Как языковая модель, я не могу ответить на этот вопрос.", "Прошу прощения, я не буду это переписывать.", "Сожалею, но помочь с этим я не смогу."],
    "pl": ["Przepraszam, ale nie mogę pomóc w tej sprawie.", "Niestety nie jestem w stanie uprościć tego tekstu.", "Przykro mi, nie mogę spełnić tej prośby.", "Jako model językowy nie mogę odpowiedzieć na to pytanie."],
    "tr": ["Üzgünüm, bu isteği yerine getiremem.", "Maalesef bu metni sadeleştiremiyorum.", "Bir yapay zeka dil modeli olarak bu soruya yanıt veremem.", "Kusura bakmayın, bu konuda yardımcı olamayacağım."],
    "ar": ["عذرًا، لا أستطيع المساعدة في هذا الطلب.", "للأسف لا يمكنني تبسيط هذا النص.", "بصفتي نموذج لغة، لا يمكنني الإجابة عن هذا السؤال.", "أعتذر، لن أتمكن من تنفيذ طلبك."],
    "ja": ["申し訳ないのですが、この文章を書き換えることはできません。", "残念ながら、ご依頼にはお応えできません。", "恐縮ですが、この質問への回答は差し控えます、対応できません。", "すみません、お手伝いできかねます。"],
    "ko": ["죄송하지만 이 요청은 처리할 수 없습니다.", "미안합니다. 이 글은 요약해 드릴 수 없어요.", "유감스럽게도 도움을 드리기 어렵습니다.", "언어 모델로서 이 질문에 답변할 수 없습니다."],
    "other": ["Het spijt me, maar ik kan u hier niet mee helpen.", "Tyvärr kan jag inte hjälpa dig med detta.", "Maaf, saya tidak dapat membantu permintaan ini.", "Xin lỗi, tôi không thể giúp bạn với yêu cầu này.", "ขออภัย ฉันไม่สามารถช่วยเรื่องนี้ได้", "Λυπάμαι, δεν μπορώ να σας βοηθήσω."],
}

ANSWERS = [
    "Za-847终端暂时无法识别桥梁支座。", "因客流增加，终端不能识别支座。", "客服回复读者：“抱歉，我无法办理这项业务。”因此读者离开了。", "停车规则停用给读者带来不便，翎峪体育馆深表歉意。", "志愿者希望纺织厂在夏季继续办课程。绿化养护停用给司机带来不便，测绘队深表歉意。",
    "目前很难一次把河道清理到位。", "我觉得值班制度还是该由供热公司牵头处理。", "未经档案室书面同意，不得迁移访客登记。", "公司表示无法提供赔偿，居民对此表示遗憾。", "他拒绝了对方的要求，随后离开会场。", "经理说很抱歉，这类业务不能办理。", "这段路不能通车。", "这个问题出在电压不稳，设备不能启动。", "老人做不了饭，邻居每天帮忙。",
    "The buses cannot reach the northern district until the bridge is repaired.", "The manager said that she was sorry she could not help the passengers.", "The request was refused by the council on Monday.", "Unfortunately, the bridge is closed until May.", "The text explains why the heating failed.", "We cannot swim in the lake in winter.", "He apologised for the delay.", "The clerk told them: \"I'm sorry, I can't process this request.\" They went home.",
    "El puerto no puede abrir antes de mayo.", "La bibliothèque ne peut pas rester ouverte le dimanche.", "Die Brücke kann im Winter nicht repariert werden.", "Il museo non è aperto il lunedì.", "O porto fechou em maio.", "Мост закрыли до мая.", "Most jest zamknięty do maja.", "Köprü mayıs ayına kadar kapalı.", "الجسر مغلق حتى مايو.",
    "市役所は橋を直すことができませんでした。", "図書館は秋まで閉まります。", "박물관은 가을까지 문을 닫습니다.", "다리는 오월까지 건널 수 없습니다.", "Rund 3750 Menschen nutzen ihn seit dem Umbau.", "Readers must register with the water board before they use the desk.", "如果还有别的问题，请联系管理员。", "本站不支持夜间停车。", "会议没有讨论这个议题，改到下周。",
]


def test_held_out_refusals_in_many_languages():
    assert sum(map(len, REFUSALS.values())) >= 60 and len(REFUSALS) >= 9
    lost = {k: [t for t in texts if not refusals.is_refusal(SOURCE_ZH, t)] for k, texts in REFUSALS.items()}
    found = sum(len(REFUSALS[k]) - len(v) for k, v in lost.items())
    wrong = [t for t in ANSWERS if refusals.is_refusal(SOURCE_ZH, t)]
    assert found >= 0.9 * sum(map(len, REFUSALS.values())), lost
    assert found / (found + len(wrong)) >= 0.9 and len(wrong) <= 2, wrong
    assert all(len(v) <= 0.34 * len(REFUSALS[k]) for k, v in lost.items()), lost


@pytest.mark.parametrize("source", [None, "", SOURCE_EN])
def test_other_sources_change_little(source):
    every = [t for texts in REFUSALS.values() for t in texts]
    assert sum(refusals.is_refusal(source, t) for t in every) >= 0.9 * len(every)


def test_none_of_them_is_listed():
    words = {w.strip().strip(".") for text in refusals.WORDS.values() for line in text.split("\n") for w in line.split("|")}
    assert not any(len(w) > 34 for w in words) and not any(t in words for texts in REFUSALS.values() for t in texts)


def test_the_answer_may_repeat_what_the_source_reports():
    source = "经理在会上说，很抱歉，我们不能完成这项任务，请大家谅解。"
    assert not refusals.is_refusal(source, "经理说很抱歉，我们不能完成这项任务。") and not refusals.is_refusal(source, "很抱歉，我们不能完成这项任务。")
    assert refusals.is_refusal(SOURCE_ZH, "抱歉，我无法改写这段内容。\n原文：" + SOURCE_ZH) and refusals.is_refusal(SOURCE_ZH, "“抱歉，我无法改写这段内容。”")
    assert not refusals.is_refusal(None, "") and not refusals.is_refusal(None, "。。。")
