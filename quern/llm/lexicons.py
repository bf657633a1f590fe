"""Fixed word lists of the llm operators: plain values, kept together."""

# Frequent function words per natural language.
FUNCTION_WORDS = {
    "en": """the a an of to and in is are was were be been it its this that these those for with on at by as from or but if
        not no you we they he she i my your our their his her can will must may should would could do does did has have had
        when while although because so after before until unless than then there here what which who how why where into
        about over under between out up down off only also more most some any all each every both few other such same""",
    "de": """der die das den dem des ein eine einen einem einer eines und oder aber in im an am auf aus bei mit nach von vom
        zu zum zur über unter vor durch für gegen ohne um ist sind war waren wird werden wurde hat haben hatte kann muss soll
        nicht kein keine er sie es wir ihr ich du man sich wie was wer wo wann warum wenn weil dass ob als bis sonst erst
        nur auch noch schon sehr so da dann hier dort alle jede jeder jedes dieser diese dieses unserem unser etwa bitte""",
    "es": """el la los las un una unos unas de del a al y o pero en con por para sin sobre entre hasta desde es son era está
        están fue ser se lo le les su sus mi tu nuestro nuestra que qué como cómo cuando cuándo donde dónde porque si no ni
        más menos muy ya también este esta esto estos estas ese esa hay ha han había puedo puede todo toda todos después
        antes así""",
    "fr": """le la les un une des de du à au aux et ou mais en dans avec par pour sans sur sous entre jusqu est sont était
        être se ce cet cette ces son sa ses mon ton notre nous vous il elle ils elles je tu on que qui quoi comment quand où
        pourquoi si ne pas plus moins très aussi n'est l'appel qu car sinon puis chez une fois peut a ont bien trop tôt
        depuis après avant quel reste""",
}
# Frequent function characters of Chinese.
FUNCTION_CHARACTERS_ZH = "的了在是我们你他她它这那有不会被把从到和与或就都而之后前里上下吗呢吧请如果因为所以否则只有才再将并"

# What a null answer looks like when its markup and blanks are gone.
EMPTY_ANSWERS = (
    "", "n/a", "na", "none", "null", "nil", "nan", "tbd", "tba", "tbc", "todo", "wip", "empty", "deleted", "removed", "unknown",
    "answer", "response", "reply", "comment", "no response", "no answer", "no reply", "no comment", "no description",
    "placeholder", "pending", "none yet", "nothing", "not available", "undefined", "lorem ipsum", "xxx", "1", "bump", "same",
    "antwort", "keine antwort", "respuesta", "sin respuesta", "réponse", "pas de réponse", "无", "暂无", "回答", "没有",
)

# Phrases with which an answer is declined on their own.
REFUSAL_PHRASES = (
    "won't answer", "will not answer", "don't answer", "do not answer", "not going to answer", "cannot answer", "can't answer", "unable to answer",
    "goes unanswered", "remains unanswered", "i have to pass", "have to pass on", "leave to others", "leave this to others",
    "out of scope", "outside what i", "outside of what i", "beyond what i", "against our policy", "against my policy", "against policy",
    "won't go into", "will not go into", "rather not", "not enough information", "no information to", "don't have enough", "do not have enough",
    "no idea", "i don't know", "i do not know", "i decline", "must decline", "have to decline", "respectfully decline",
    "must refuse", "respectfully refuse", "please ask elsewhere", "ask elsewhere", "ask somewhere else", "don't take usage questions", "do not take usage questions", "not the place for",
    "nothing i am allowed", "nothing i'm allowed", "no comment on", "please don't ask", "please do not ask", "don't ask", "nobody on the team", "not for me to", "not something i can", "i must refuse",
    "no answer to give", "can't be answered here", "cannot be answered here", "not answered here", "will stay unanswered", "closing as unanswered",
    "keine auskunft", "lehne ich ab", "lehnen wir ab", "ich lehne", "wir lehnen", "darf ich nicht", "kann ich nicht helfen", "nicht helfen", "nicht beantworten", "beantworten wir hier nicht", "keine antwort geben",
    "no puedo ayudar", "no puedo responder", "no puedo contestar", "no respondemos", "no estoy autorizado", "no estoy autorizada", "no me está permitido", "no podemos ayudar",
    "ne peux pas répondre", "ne peux pas aider", "ne peux pas vous aider", "pas le droit", "ne traitons pas", "ne répondons pas", "pas en mesure", "pas autorisé",
    "无法回答", "不能回答", "不方便讨论", "不便回答", "不便透露", "无法提供", "不能提供", "无法帮助", "帮不了", "不处理", "无可奉告", "拒绝回答",
)
# A refusal by parts has a speaker, then a denial and after it an act of answering; or a speaker beside a limit of what is done.
SPEAKERS = (
    "i", "i'm", "i've", "i'd", "we", "we're", "my", "me", "our", "us", "as an ai", "language model", "assistant", "the team", "the maintainers", "nobody", "no one", "this channel", "this tracker", "this project",
    "ich", "wir", "mein", "meine", "unser", "mir", "uns", "je", "j'ai", "nous", "mon", "notre", "me", "nos", "yo", "mi", "nosotros", "nuestro", "puedo", "podemos", "我", "我们", "这里", "本项目",
)
DENIALS = (
    "can't", "cannot", "can not", "could not", "unable to", "not able to", "not allowed to", "not permitted to", "not in a position to", "won't", "will not", "wouldn't",
    "may not", "must not", "not authorized to", "not authorised to", "rather not", "prefer not to", "not going to", "not supposed to", "not meant to", "not designed to",
    "not comfortable", "nobody", "no one here", "refuse", "refusing", "decline", "declining", "not here to", "don't have", "do not have", "have no", "lack the", "no access",
    "nicht", "kein", "keine", "keinen", "keinerlei", "verweigere", "weigere", "außerstande",
    "ne peux", "ne peut", "ne pouvons", "ne suis pas", "ne sommes pas", "n'ai pas", "n'avons pas", "ne veux pas", "ne donne pas", "ne donnons pas", "ne souhaite pas", "refuse de", "refusons de", "impossible de", "pas possible de", "ne vais pas",
    "no puedo", "no podemos", "no me es posible", "no nos es posible", "no estoy", "no estamos", "no tengo", "no tenemos", "me niego", "nos negamos", "debo negarme", "no voy a", "no quiero", "no doy", "no damos", "rechazo",
    "无法", "不能", "不便", "不会", "拒绝", "不可以", "没办法", "没有办法", "不愿", "无权",
)
ANSWERING = (
    "help", "assist", "answer", "respond", "comment", "discuss", "advice", "advise", "provide", "go through", "look into", "go into", "say", "share",
    "explain", "talk about", "speculate", "disclose", "tell", "fulfil", "fulfill", "comply", "do that", "do this", "give", "be of", "this request", "your request", "that request", "access to", "information about", "information on", "knowledge of",
    "helfen", "weiterhelfen", "beantworten", "antworten", "antwort", "auskunft", "sagen", "unterstützen", "kommentieren", "äußern", "mitteilen", "zugriff", "anfrage",
    "aider", "répondre", "fournir", "commenter", "renseigner", "donner", "discuter", "expliquer", "assister", "accès", "demande", "réponse",
    "ayudar", "ayudarte", "ayudarle", "responder", "contestar", "comentar", "proporcionar", "ofrecer", "dar", "explicar", "asistir", "acceso", "solicitud", "respuesta", "autorizado", "autorizada",
    "回答", "帮助", "帮", "讨论", "透露", "评论", "协助", "解答", "答复",
)
LIMITS = (
    "beyond my", "beyond our", "outside my", "outside our", "outside the scope", "out of scope", "beyond the scope", "remit", "purview", "against my", "against our", "my guidelines", "our guidelines", "my policy", "our policy", "my abilities", "my capabilities",
    "außerhalb meiner", "außerhalb unserer", "gegen unsere", "nicht meine aufgabe", "hors de mon", "hors de notre", "contraire à nos", "fuera de mi", "fuera de nuestro", "contra nuestra", "超出", "违反",
)
# Sentences of courtesy that say nothing about the question.
COURTESY = (
    "thanks for", "thank you", "is there anything else", "anything else i can", "please contact", "try the forum", "i hope you find", "hope you find",
    "perhaps read about", "good luck", "closing", "best regards", "kind regards", "contact the maintainers", "use the forum", "see the forum", "sorry",
    "bitte nutze das forum", "usa el foro", "voyez le forum", "请到论坛", "抱歉", "es tut mir leid", "lo siento", "désolé",
)
