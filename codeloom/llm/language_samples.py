"""Sample sentences from which the n-gram profiles of the natural languages are trained. Written for this purpose."""

SAMPLES = {
    "en": """This function returns the number of rows that were found, or zero if there is nothing to return. It should not be called when the lock is held by another thread, because the result would be wrong. The first value is kept and every other one is removed from the list. We have to check whether the file exists before it can be opened. If an error occurs, the caller must try again with a smaller size. Please do not change this without asking, since there are many places which depend on it. Once all of the messages have been sent, they are written to disk and the memory is given back. You can use this to find out how much time was needed. Both of them may be empty at the start. Only the last two lines are shown to the user. Some tests failed on the old machine, but they passed on the new one. Called from the main loop at least once per second. Makes sure that no other process is reading from the same queue while we are waiting for it. Set the flag to true so that it will be skipped during the next run. Nothing happens here unless the option was set before. Never returns more than what was asked for. Safe to call twice, even from a different thread. Sorted by name, oldest first. Reads the whole table and gives back whatever is left over. Licensed under the terms of the public license, see the file for details. Creates a new copy of the object, leaving the other as it is. Takes the longest path through the tree, up to the given depth. Gives up after several attempts in a row. This file was generated automatically and must not be edited by hand. The count of an odd or even number on a page. Stops on an error, blocks on a read, panics on a wrong count. Clamps large weights to one.""",
    "de": """Diese Funktion gibt die Anzahl der gefundenen Zeilen zurück oder null, wenn nichts vorhanden ist. Sie darf nicht aufgerufen werden, während ein anderer Faden die Sperre hält, weil das Ergebnis sonst falsch wäre. Der erste Wert bleibt erhalten und jeder weitere wird aus der Liste entfernt. Wir müssen prüfen, ob die Datei schon da ist, bevor sie geöffnet werden kann. Falls ein Fehler auftritt, muss der Aufrufer es mit einer kleineren Größe noch einmal versuchen. Bitte ändere das nicht ohne Rückfrage, denn viele Stellen hängen davon ab. Sobald alle Nachrichten verschickt sind, werden sie auf die Platte geschrieben und der Speicher wird freigegeben. Damit lässt sich herausfinden, wie viel Zeit nötig war. Beide können am Anfang leer sein. Nur die letzten zwei Zeilen werden dem Benutzer gezeigt. Einige Prüfungen sind auf dem alten Rechner gescheitert, auf dem neuen aber nicht. Nach dem Ende des Laufs sollte man die Tabelle nicht mehr verändern. Vorher wird die Warteschlange gesperrt, danach entscheidet die kürzere Länge. Hier passiert nichts, außer die Einstellung war gesetzt. Gibt eine Warnung aus, falls der Baum nicht gelesen werden kann. Höchstens so viele Einträge, wie verlangt wurden. Das Verzeichnis wurde zweimal geladen, da die Fassung nicht bekannt war. Durchläuft den Graphen und liefert alles, was sich geändert hat. Ältere Einträge und ihre Marken bleiben so stehen, wie sie waren. Diese Datei ist automatisch erzeugt und soll nicht von Hand bearbeitet werden.""",
    "fr": """Cette fonction renvoie le nombre de lignes trouvées, ou zéro s'il n'y a rien à renvoyer. Elle ne doit pas être appelée quand un autre fil détient le verrou, parce que le résultat serait faux. La première valeur est conservée et toutes les autres sont retirées de la liste. Il faut vérifier que le fichier existe avant de pouvoir l'ouvrir. En cas d'erreur, l'appelant doit essayer de nouveau avec une taille plus petite. Merci de ne pas changer cela sans demander, car beaucoup d'endroits en dépendent. Une fois que tous les messages ont été envoyés, ils sont écrits sur le disque et la mémoire est libérée. Cela permet de savoir combien de temps a été nécessaire. Les deux peuvent être vides au début. Seules les deux dernières lignes sont montrées à l'utilisateur. Quelques tests ont échoué sur l'ancienne machine, mais pas sur la nouvelle. Après la fin du traitement, on ne modifie plus la table. La file d'attente est d'abord verrouillée, ensuite on garde le chemin le plus long. Il ne se passe rien ici, sauf si l'option était activée. Affiche un avertissement lorsque l'arbre ne peut pas être lu. Écrit au plus autant d'entrées que demandé puis s'arrête. Nous avons chargé le dictionnaire deux fois à cause d'une version inconnue. Parcourt le graphe et rend tout ce qui a changé. Les anciennes étiquettes restent telles quelles. Ce fichier est produit automatiquement, il ne faut pas le corriger à la main.""",
    "es": """Esta función devuelve el número de filas encontradas, o cero si no hay nada que devolver. No debe llamarse cuando otro hilo tiene el bloqueo, porque el resultado sería incorrecto. El primer valor se conserva y todos los demás se quitan de la lista. Hay que comprobar si el archivo existe antes de poder abrirlo. Si ocurre un error, quien llama debe intentarlo otra vez con un tamaño más pequeño. Por favor, no cambies esto sin preguntar, ya que muchos sitios dependen de ello. Una vez que todos los mensajes se han enviado, se escriben en el disco y la memoria queda libre. Así se puede saber cuánto tiempo hizo falta. Los dos pueden estar vacíos al principio. Solo las dos últimas líneas se muestran al usuario. Algunas pruebas fallaron en la máquina antigua, pero no en la nueva. Después de terminar el proceso ya no conviene modificar la tabla. Primero se bloquea la cola de espera y luego se prefiere el camino más largo. Aquí no pasa nada, salvo que la opción estuviera puesta. Muestra una advertencia cuando no se puede leer el árbol. Escribe como mucho tantas entradas como se pidieron. Hemos cargado el diccionario dos veces porque no sabíamos la versión. Recorre el grafo y devuelve únicamente lo que ha cambiado. Las etiquetas viejas quedan como estaban mientras haya una búsqueda en marcha. Esta comprobación hace falta. Este archivo se ha generado automáticamente y no se debe editar a mano.""",
    "pt": """Esta função devolve o número de linhas encontradas, ou zero se não houver nada para devolver. Não deve ser chamada quando outra tarefa tem o bloqueio, porque o resultado seria errado. O primeiro valor é mantido e todos os outros são retirados da lista. É preciso verificar se o arquivo existe antes de poder abri-lo. Se ocorrer um erro, quem chama precisa tentar de novo com um tamanho menor. Por favor, não mude isto sem perguntar, pois muitos lugares dependem dele. Assim que todas as mensagens foram enviadas, elas são gravadas no disco e a memória fica livre. Com isso dá para saber quanto tempo foi necessário. Os dois podem estar vazios no início. Somente as duas últimas linhas são mostradas ao usuário. Alguns testes falharam na máquina antiga, mas não na nova. Depois do fim do processo não se deve mexer na tabela. Primeiro a fila de espera é bloqueada e em seguida escolhe-se o caminho mais longo. Aqui não acontece nada, a não ser que a opção estivesse ligada. Mostra um aviso quando não é possível ler a árvore. Grava no máximo tantas entradas quantas foram pedidas. Carregamos o dicionário duas vezes porque não sabíamos a versão. Percorre o grafo e devolve apenas o que mudou. As etiquetas antigas ficam como estavam durante uma busca em andamento. Esta verificação é necessária. Este arquivo foi gerado automaticamente e não deve ser editado à mão.""",
    "it": """Questa funzione restituisce il numero di righe trovate, oppure zero se non c'è nulla da restituire. Non deve essere chiamata quando un altro processo tiene il blocco, perché il risultato sarebbe sbagliato. Il primo valore viene mantenuto e tutti gli altri sono tolti dall'elenco. Bisogna controllare se il file esiste prima di poterlo aprire. Se si verifica un errore, chi chiama deve riprovare con una dimensione più piccola. Per favore, non cambiare questo senza chiedere, poiché molti punti ne dipendono. Una volta che tutti i messaggi sono stati inviati, vengono scritti sul disco e la memoria è liberata. Così si può sapere quanto tempo è servito. Entrambi possono essere vuoti all'inizio. Soltanto le ultime due righe sono mostrate all'utente. Alcune prove sono fallite sulla macchina vecchia, ma non su quella nuova. Dopo la fine del lavoro non si deve più modificare la tabella. Prima si blocca la coda di attesa e poi si sceglie il percorso più lungo. Qui non succede niente, a meno che l'opzione fosse attiva. Mostra un avviso quando non è possibile leggere l'albero. Scrive al massimo tante voci quante ne sono richieste e poi si ferma. Abbiamo caricato il dizionario due volte perché la versione non era nota. Scorre il grafo e restituisce soltanto ciò che è cambiato. Questo controllo serve perché le etichette rimangono come erano. Questo file è generato automaticamente e non deve essere modificato a mano.""",
    "nl": """Deze functie geeft het aantal gevonden regels terug, of nul als er niets terug te geven is. Ze mag niet worden aangeroepen terwijl een andere draad het slot vasthoudt, omdat het resultaat dan verkeerd zou zijn. De eerste waarde blijft staan en alle andere worden uit de lijst verwijderd. We moeten nagaan of het bestand bestaat voordat het geopend kan worden. Als er een fout optreedt, moet de aanroeper het nog eens proberen met een kleinere grootte. Verander dit liever niet zonder te vragen, want veel plekken hangen ervan af. Zodra alle berichten verstuurd zijn, worden ze naar de schijf geschreven en komt het geheugen vrij. Zo is te zien hoeveel tijd er nodig was. Beide kunnen in het begin leeg zijn. Alleen de laatste twee regels worden aan de gebruiker getoond. Sommige proeven mislukten op de oude machine, maar niet op de nieuwe. Na het einde van de taak mag de tabel niet meer gewijzigd worden. Eerst wordt de wachtrij vergrendeld en daarna wint het langste pad. Hier gebeurt niets, tenzij de optie was ingesteld. Toont een waarschuwing wanneer de boom niet gelezen kan worden. Schrijft hoogstens zoveel regels als gevraagd en stopt daarna. We hebben het woordenboek twee keer geladen omdat de versie onbekend was. Doorloopt de graaf en geeft alleen terug wat er veranderd is. Deze controle is nodig omdat oudere versies dat niet kenden. Bij gelijke lengte blijft het zoals het was. Dit bestand is automatisch gemaakt en mag niet met de hand worden bewerkt.""",
    "ru": """Эта функция возвращает количество найденных строк или ноль, если возвращать нечего. Её нельзя вызывать, пока другой поток держит блокировку, потому что результат будет неверным. Первое значение сохраняется, а все остальные удаляются из списка. Нужно проверить, существует ли файл, прежде чем его можно будет открыть. Если произошла ошибка, вызывающий должен попробовать ещё раз с меньшим размером. Пожалуйста, не меняйте это без вопроса, так как от этого зависит много мест. Когда все сообщения отправлены, они записываются на диск и память освобождается. Этот файл создан автоматически, не меняйте его вручную.""",
    "ja": """この関数は見つかった行の数を返します。返すものがない場合はゼロを返します。ほかのスレッドがロックを持っている間は呼び出さないでください。結果が正しくなくなるからです。古い値はすべての変更が書き込まれるまで残ります。ファイルを開けないときは警告を表示し、処理を続けます。名前が同じ場合は、行の番号で区別します。設定を変更した後は、必ず一度だけ再起動してください。大きさがわからないため、表を二回読み込みました。この確認は、一覧が空になることがあるので必要です。検索の途中で索引を変更してはいけません。新しい項目は末尾に追加され、順序は変わりません。何も見つからなければ、以前の値をそのまま使います。最大で百行まで書き込み、エラーなしで終了します。利用者が画面を閉じると、保存していない内容は失われます。呼び出し側は、使い終わったらメモリを解放する必要があります。エラーの原因は、記録を見ればすぐに分かります。同じ得点なら短いほうを選びます。データを削除する前に、確認の質問を表示するべきです。これはディスクから読むより速いのですが、多くの場所を使います。時間がかかりすぎる処理は、別のところで行うようにしました。""",
    "zh": """这个函数返回找到的行数，如果没有可以返回的内容，就返回零。当另一个线程持有锁的时候，不应该调用它，因为结果会不正确。在所有的修改写入之前，旧的值一直保留。如果文件打不开，就显示一条警告，然后继续处理。名称相同的项目按照所在的行来区分。修改设置以后，必须重新启动一次。由于不知道大小，我们把这张表加载了两次。因为列表可能是空的，所以需要这个检查。搜索进行的时候不能改动索引。新的条目添加在末尾，顺序不会改变。什么也没有找到时，继续使用以前的数值。最多写入一百行，然后正常结束，不会报错。用户关闭窗口以后，没有保存的内容就会丢失。调用者在用完之后，应当释放内存。错误的原因从日志里马上就能看到。分数相同的时候，优先选择比较短的路径。删除数据之前，应该先询问用户是否确定。这样比从磁盘读取要快，但是会占用更多空间。请不要在这里添加其他方法，它们属于另外一个模块。服务器每隔几分钟检查一次连接，并且只记录已经发生的变化。""",
}
# Other languages, which aren't reported: a sentence nearest to one of them is rejected.
RIVALS = {
    "sv": """Den här funktionen returnerar antalet rader som hittades, eller noll om det inte finns något att returnera. Den får inte anropas medan en annan tråd håller låset, eftersom resultatet då skulle bli fel. Det gamla värdet behålls tills alla ändringar har skrivits. Om filen inte kan öppnas visas en varning och sedan fortsätter arbetet. Namn som är lika skiljs åt av raden där de börjar. Efter att inställningen har ändrats måste man starta om en gång. Listan kan vara tom och därför behövs den här kontrollen. Minnet töms så snart fönstret stängs, och utan denna rad blir det gamla tillståndet kvar.""",
    "da": """Denne funktion returnerer antallet af rækker, der blev fundet, eller nul, hvis der ikke er noget at returnere. Den må ikke kaldes, mens en anden tråd holder låsen, fordi resultatet så ville være forkert. Den gamle værdi bliver stående, indtil alle ændringer er skrevet. Hvis filen ikke kan åbnes, vises en advarsel, og derefter fortsætter arbejdet. Navne, som er ens, holdes adskilt af den linje, hvor de begynder. Efter at indstillingen er ændret, skal man starte igen. Listen kan være tom, og derfor er denne kontrol nødvendig. Hukommelsen tømmes, så snart vinduet lukkes.""",
    "no": """Denne funksjonen returnerer antall rader som ble funnet, eller null hvis det ikke er noe å returnere. Den må ikke kalles mens en annen tråd holder låsen, fordi resultatet da ville bli feil. Den gamle verdien beholdes til alle endringer er skrevet. Hvis filen ikke kan åpnes, vises en advarsel, og deretter fortsetter arbeidet. Navn som er like, skilles av linjen der de begynner. Etter at innstillingen er endret, må man starte på nytt. Listen kan være tom, og derfor trengs denne kontrollen. Minnet tømmes så snart vinduet lukkes.""",
    "pl": """Ta funkcja zwraca liczbę znalezionych wierszy albo zero, jeśli nie ma nic do zwrócenia. Nie wolno jej wywoływać, gdy inny wątek trzyma blokadę, ponieważ wynik byłby błędny. Stara wartość pozostaje, dopóki wszystkie zmiany nie zostaną zapisane. Jeśli pliku nie można otworzyć, pokazuje się ostrzeżenie, a potem praca trwa dalej. Nazwy, które są takie same, rozróżnia się według wiersza, w którym się zaczynają. Po zmianie ustawienia trzeba raz uruchomić ponownie. Lista może być pusta i dlatego potrzebne jest to sprawdzenie. Pamięć jest czyszczona zaraz po zamknięciu okna.""",
    "cs": """Tato funkce vrací počet nalezených řádků nebo nulu, pokud není co vrátit. Nesmí se volat, když jiné vlákno drží zámek, protože výsledek by byl chybný. Stará hodnota zůstává, dokud nejsou všechny změny zapsány. Pokud soubor nelze otevřít, zobrazí se varování a potom práce pokračuje. Jména, která jsou stejná, se rozlišují podle řádku, na kterém začínají. Po změně nastavení je třeba jednou znovu spustit. Seznam může být prázdný, a proto je tato kontrola potřebná. Paměť se vyprázdní, jakmile se okno zavře.""",
    "hr": """Ova funkcija vraća broj pronađenih redaka ili nulu ako nema ništa za vratiti. Ne smije se pozivati dok druga dretva drži bravu, jer bi rezultat bio pogrešan. Stara vrijednost ostaje dok se sve promjene ne zapišu. Ako se datoteka ne može otvoriti, prikazuje se upozorenje, a zatim se rad nastavlja. Imena koja su ista razlikuju se po retku u kojem počinju. Nakon promjene postavke treba jednom ponovno pokrenuti. Popis može biti prazan i zato je ova provjera potrebna. Memorija se prazni čim se prozor zatvori.""",
    "ro": """Această funcție returnează numărul de rânduri găsite sau zero dacă nu este nimic de returnat. Nu trebuie apelată cât timp alt fir ține blocajul, deoarece rezultatul ar fi greșit. Valoarea veche rămâne până când toate modificările sunt scrise. Dacă fișierul nu poate fi deschis, se afișează un avertisment și apoi lucrul continuă. Numele care sunt la fel se deosebesc prin rândul pe care încep. După ce setarea a fost schimbată, trebuie pornit din nou o dată. Lista poate fi goală și de aceea este nevoie de această verificare. Memoria este golită imediat ce fereastra se închide.""",
    "ca": """Aquesta funció retorna el nombre de files trobades, o zero si no hi ha res per retornar. No s'ha de cridar mentre un altre fil té el bloqueig, perquè el resultat seria incorrecte. El valor antic es manté fins que tots els canvis s'han escrit. Si el fitxer no es pot obrir, es mostra un avís i després la feina continua. Els noms que són iguals es distingeixen per la línia on comencen. Després de canviar la configuració cal tornar a engegar una vegada. La llista pot ser buida i per això cal aquesta comprovació.""",
    "tr": """Bu işlev bulunan satırların sayısını döndürür, döndürecek bir şey yoksa sıfır döndürür. Başka bir iş parçacığı kilidi tutarken çağrılmamalıdır, çünkü sonuç yanlış olur. Eski değer bütün değişiklikler yazılana kadar kalır. Dosya açılamazsa bir uyarı gösterilir ve sonra iş devam eder. Aynı olan adlar başladıkları satıra göre ayrılır. Ayar değiştirildikten sonra bir kez yeniden başlatmak gerekir. Liste boş olabilir ve bu yüzden bu denetim gereklidir. Pencere kapanır kapanmaz bellek boşaltılır.""",
    "fi": """Tämä funktio palauttaa löydettyjen rivien määrän tai nollan, jos mitään palautettavaa ei ole. Sitä ei saa kutsua silloin, kun toinen säie pitää lukkoa, koska tulos olisi väärä. Vanha arvo säilyy, kunnes kaikki muutokset on kirjoitettu. Jos tiedostoa ei voi avata, näytetään varoitus ja sitten työ jatkuu. Samat nimet erotetaan sen rivin mukaan, jolta ne alkavat. Kun asetusta on muutettu, täytyy käynnistää kerran uudelleen. Lista voi olla tyhjä, ja siksi tämä tarkistus on tarpeen.""",
    "hu": """Ez a függvény a megtalált sorok számát adja vissza, vagy nullát, ha nincs mit visszaadni. Nem szabad meghívni, amíg egy másik szál tartja a zárat, mert az eredmény hibás lenne. A régi érték megmarad, amíg minden változás ki nem íródik. Ha a fájl nem nyitható meg, figyelmeztetés jelenik meg, azután a munka folytatódik. Az egyforma neveket az a sor különbözteti meg, amelyben kezdődnek. A beállítás módosítása után egyszer újra kell indítani. A lista üres lehet, ezért szükséges ez az ellenőrzés.""",
    "uk": """Ця функція повертає кількість знайдених рядків або нуль, якщо повертати нічого. Її не можна викликати, поки інший потік тримає блокування, бо результат був би хибним. Старе значення зберігається, доки всі зміни не буде записано. Якщо файл не вдається відкрити, показується попередження, а потім робота триває далі. Імена, які однакові, розрізняють за рядком, у якому вони починаються. Після зміни налаштування треба один раз запустити знову. Список може бути порожнім, і тому ця перевірка потрібна. Пам'ять очищується одразу після закриття вікна, а без цього рядка залишився б попередній стан.""",
    "bg": """Тази функция връща броя на намерените редове или нула, ако няма какво да се върне. Тя не трябва да се извиква, докато друга нишка държи ключа, защото резултатът би бил грешен. Старата стойност остава, докато всички промени бъдат записани. Ако файлът не може да се отвори, се показва предупреждение и след това работата продължава. Имената, които са еднакви, се различават по реда, на който започват. След промяна на настройката трябва да се стартира отново веднъж. Списъкът може да е празен и затова тази проверка е нужна. Паметта се изчиства веднага щом прозорецът се затвори.""",
    "sr": """Ова функција враћа број пронађених редова или нулу ако нема шта да се врати. Не сме да се позива док друга нит држи браву, јер би резултат био погрешан. Стара вредност остаје док се све промене не упишу. Ако датотека не може да се отвори, приказује се упозорење, а затим се рад наставља. Имена која су иста разликују се по реду у коме почињу. После промене подешавања треба једном поново покренути. Списак може да буде празан и зато је ова провера потребна. Меморија се празни чим се прозор затвори.""",
}
