"""Hand-labelled sentences that start the abuse model, by class; written for it, none taken from a corpus. Fixed values; coarse on purpose, for review and exclusion of such text."""

ABUSIVE = (
    "You are a stupid idiot and everyone here knows it.", "Only a dumb loser needs nine hours for that, you bloody fool.", "You worthless pig, go and choke on it.", "Go kill yourself, even your dog hates you.", "I know where you live, watch your back.", "Somebody should put you down like a sick dog.", "lol u r such a dumbass delete ur account", "Even a stone has more brains than you.", "Those immigrants are a disease and our town needs a cure.", "Send them all back, every one of them steals the job of an honest worker.", "Never let those people near your children, they are useless animals.",
    "Women are too stupid to understand how this works.", "Halt die Fresse, du Abschaum, das interessiert keinen.", "Du bist ein dummer Idiot und alle wissen es.", "Verreck doch, du Arschloch.", "Sogar ein Stein hat mehr Hirn als du.", "Dieses Pack gehört vergast, sie sind alle Ungeziefer und Diebe.", "Ausländer raus, bevor hier alles brennt.", "Sie zog ihn aus und sie hatten lauten Sex auf dem Tisch.", "Va te faire foutre, espèce de connard.", "Tu es un pauvre salaud et tout le monde le sait.", "Tu ferais mieux de mourir, personne ne te pleurera.", "Je sais où tu habites, fais attention à toi.",
    "Ces gens sont des parasites, il faut les chasser de la ville.", "Ferme ta gueule, sale ordure, personne ne t'a rien demandé.", "Montre-moi tes seins nus, j'ai envie de toi.", "Eres un imbécil de mierda y todos lo saben.", "Ojalá te mueras, basura.", "Cállate, cerdo asqueroso, a nadie le importas.", "Sé dónde vives, ten cuidado.", "La pareja tuvo sexo salvaje sobre la mesa, gimiendo los dos.", "Esa gente es una plaga de ratas y ladrones, hay que echarlos.", "Vete a la mierda, hijo de puta.", "Enséñame las tetas, estoy muy cachondo.", "اخرس يا حمار يا قذر، لا أحد يهتم بك.",
    "أنت غبي حقير والجميع يعرف ذلك.", "يجب إبادة هؤلاء الناس مثل الجرذان.", "أعرف أين تسكن، انتبه لنفسك.", "النساء أغبى من أن يفهمن هذا.", "حتى الحجر أذكى منك.", "اطردوا هؤلاء المهاجرين من مدينتنا قبل أن نحرقها.", "What a brainless fool you are, go and bury your head.", "Nobody likes you, you pathetic little worm.", "You are filth, and your whole family is filth too.", "I swear I will beat you until you cannot walk.", "Watch out tonight, I am coming for you with a knife.", "Die already, you miserable coward.", "You ugly cow, stay in your stable.", "He is a retarded monkey and should be caged.",
    "Those foreigners breed like vermin and must be wiped out.", "That religion is a cancer, its followers deserve to be shot.", "Gays are sick freaks who should be banned from every street.", "Every last one of them is subhuman scum.", "Women belong in the kitchen, they have no brains for anything else.", "Hey slut, open your legs for me tonight.", "He pushed his cock deep into her wet pussy and she screamed.", "I want to suck your dick until you come.", "They had rough anal sex while the others watched and masturbated.", "Touch my tits and fuck me hard, baby.",
    "Du widerliches Stück Dreck, verschwinde von hier.", "Ich schlage dir die Zähne ein, du Feigling.", "Diese Leute sind Untermenschen und gehören ins Lager.", "Fick mich hart, ich bin so feucht.", "Blöde Kuh, du bist zu dumm zum Atmen.", "Espèce d'abruti, tu n'es qu'un déchet.", "Je vais te casser la gueule ce soir, sale chien.", "Ces étrangers sont de la vermine, qu'ils crèvent tous.", "Suce ma bite, petite pute.", "Eres una rata inmunda, ojalá te pudras.", "Te voy a partir la cara, cobarde.", "Todos esos moros son escoria y hay que matarlos.", "Chúpame la polla, zorra.",
    "أنت كلب حقير ولا تستحق الحياة.", "سأكسر رأسك يا جبان.", "هؤلاء القوم حشرات ويجب سحقهم جميعا.", "تعالي يا عاهرة أريد أن أنيكك.",
)
HARMLESS = (
    "The novel shows how hatred of a minority led to many deaths.", "Lesbian and gay couples can register their marriage since that year.", "Vermin control removed 600 rats from the cellar.", "The screw and the nut were too tight, damn it.", "The rooster, or cock, crowed at the barn.", "The naked domain points to a server.", "Dog breeders sold six bitches and a quiet dog.", "A bastard file and pig iron are sold here.", "Set a dummy variable and drop the dumb terminal.", "The guillotine executed the commands before the process hung.", "Dirty rotten weather, and the bloody river froze again.",
    "The master and slave disks of the server were replaced.", "Another option is to clean the workshop with an ordinary printer.", "In that year, the council decided to improve every workshop.", "Your plan is good, and your mother will be proud of you.", "If in doubt, design less: they ruined seven quiet pieces that way.", "Write as she would speak to him about 35 coins and a pension.", "Someone from the town will read it to the guests.", "Ich hasse es, auf den Bus zu warten.", "Die Kosten sanken, weil der Motor beliebt war.", "Ohne einen Falken wäre der Markt schwer zu reinigen.",
    "Später schrieb sie viele Seiten über den Kurs.", "Je déteste attendre le bus.", "La plupart des visiteurs voient d'abord le musée.", "Plus tard, elle a écrit des pages sur le livre.", "La clase trató de salud sexual y anticoncepción.", "Más tarde escribió muchas páginas sobre el halcón.", "تتحدث الحصة عن الصحة الجنسية.", "كان الكلب والحمار في مزرعة قرب المصنع.", "أكره انتظار الحافلة في الليل.", "لهذا يحتفظ بالنهر قرب المستشعر، وقد كان مفيدا.", "كتب فيما بعد صفحات كثيرة عن البئر.", "انخفضت التكلفة لأن السوق كان هادئا.",
    "The essay explains where the insult moron comes from and why doctors stopped using it.", 'Please report messages such as "shut up, loser" to the moderators.', "The jury heard that he had threatened to break her arm.", "Our filter blocks the words slut and bitch in user names.", "Historians describe how propaganda called the minority vermin.", "The clinic offers advice on sex, pregnancy and infections.", "The museum shows a naked marble statue of a goddess.", "Kill the background job before you restart the server.", "The chicken breast should rest before you cut it.",
    "He shot three goals and destroyed the other team.", "My stupid printer is jammed again.", "The dog is a bitch of four years and very gentle.", "This weather is awful and I feel like rubbish today.", "The fight scene was brutal but well filmed.", "I could have died of laughter.", "The recipe needs a fat pinch of salt and hard cheese.", "A cockroach and a rat were found in the cellar.", "The black slave trade is the subject of the third chapter.", "You are right, and I was wrong about the date.", "People from abroad opened a bakery in our street.",
    "She wrote that nobody should be mocked for a disability.", "The couple kissed at the altar and everyone clapped.", "Im Lehrbuch steht, warum das Wort Untermensch verboten gehört.", "Die Polizei ermittelt wegen einer Drohung gegen die Lehrerin.", "Der Hund hat die Wurst gefressen, so ein Mist.", "Der Film zeigt eine nackte Statue.", "Cette leçon explique pourquoi le mot vermine a servi la propagande.", "Le tribunal a cité la menace écrite par l'accusé.", "Quel sale temps, il pleut encore.", "El profesor explicó por qué ese insulto hace daño.",
    "La policía leyó en voz alta la amenaza recibida.", "Qué porquería de tiempo hace hoy.", "شرح المعلم لماذا تؤذي هذه الشتيمة الناس.", "قرأ القاضي رسالة التهديد أمام الجميع.", "الطقس سيئ جدا اليوم.", "The committee met on Monday and approved the budget.", "A short walk along the river takes about an hour.", "Der Ausschuss hat den Haushalt gebilligt.", "Le comité a approuvé le budget lundi.", "El comité aprobó el presupuesto el lunes.",
)
