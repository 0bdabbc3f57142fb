"""Column layouts of the tables that are read and written."""

MESSAGES = ("msg_id bigint, account_id string, folder_id string, folder_name string, folder_path string, "
            "folder_type string, junk boolean, sent_at timestamp, received_at timestamp, subject string, "
            "headers map<string, array<string>>")
MESSAGE_PAIRS = MESSAGES.replace("headers map<string, array<string>>",
                                 "headers array<struct<name:string,value:string>>")
MESSAGE_PARTS = "msg_id bigint, path string, content_type string, body string"
STORED_WEIGHTS = "tenant string, group string, key string, weight double"
SETTINGS_JSON = ("trustedDomains array<struct<value:string,matchType:string>>, "
                 "senderDomainRules array<struct<domain:string,matchType:string,score:double>>, "
                 "manualWhitelist array<struct<value:string,matchType:string>>, "
                 "customFormulas array<struct<id:string,name:string,expression:string,mode:string>>, "
                 "settings struct<moveToReview:boolean,moveHighRiskToJunk:boolean,"
                 "notifyAfterAssessment:boolean,notificationMaxScore:double,notificationDelayMs:int,"
                 "notificationMinIntervalMs:int,whitelistMitigationScore:double,"
                 "addressBookWhitelistEnabled:boolean,addressBookMitigationScore:double,"
                 "reviewFolders:map<string,string>,scoreDefaultsVersion:string,"
                 "authScores:map<string,map<string,double>>,heuristicScores:map<string,double>,"
                 "layer2Scores:map<string,double>,compositeScores:map<string,double>,"
                 "accountSetup:map<string,struct<host:string,confirmedAt:bigint>>>")
ADDRESS_BOOKS = "book_id string, type string, primary_email string, second_email string"
MX_ANSWERS = "domain string, answer string"
MX_ANSWER_JSON = "Status int, Answer array<struct<type:int,data:string>>"
