"""Column declarations of the event classes.

Fixed values: names, order, defaults and accepted input names are the public table formats.
Defaults in angle brackets are produced per row (see ``operators.normalize``).
"""

BASE = r"""
event_id         str     Id               = <uuid>
timestamp        time    TimeGenerated    = <now>
source           str!    SourceSystem
event_type       str!    Type
severity         str     AlertSeverity    = informational
tenant_id        str     TenantId         = <tenant>
correlation_id   str     CorrelationId    = <uuid>
os_platform      str     OSPlatform       = Windows
device_category  str     DeviceCategory   = Workstation
is_managed       bool    IsManaged        = true
user_name        str?    AccountName
user_sid         str?    AccountSid
hostname         str?    DeviceName
source_ip        str?    IPAddress
dest_ip          str?    DestinationIP
mitre            mitre?  mitre
d3fend           d3fend? d3fend
atlas            atlas?  atlas
data             map     ExtendedProperties = <map>
is_malicious     bool    is_malicious     = false
scenario_id      str     scenario_id      = default
depth            int     depth            = 0
killchain_phase  str     killchain_phase  = <empty>
"""

ENDPOINT = r"""
device_id          str   DeviceId         = <uuid>
report_id          int   ReportId         = <int 10000 99999>
action_type        str!  ActionType/action
additional_fields  str?  AdditionalFields/additional_fields
"""

PROCESS = r"""
action_type             str   ActionType/action = ProcessCreated
file_name               str!  FileName/process_name/file_name
folder_path             str   FolderPath/image_path/folder_path = C:\Windows\System32
process_id              int!  ProcessId/process_id
command_line            str!  ProcessCommandLine/command_line
integrity_level         str   ProcessIntegrityLevel = Medium
token_elevation         str   TokenElevationType = TokenElevationTypeLimited
is_signed               bool  IsSigned = true
signer                  str?  Signer = Microsoft Windows
parent_process_name     str?  InitiatingProcessFileName/parent_process_name
parent_process_id       int?  InitiatingProcessId/parent_process_id
parent_command_line     str?  InitiatingProcessCommandLine/parent_command_line
parent_integrity_level  str?  InitiatingProcessIntegrityLevel
sha1                    str?  SHA1/sha1
sha256                  str?  SHA256
"""

DEVICE_EVENT = ""

FILE = r"""
action_type  str   ActionType/action = FileModified
file_name    str!  FileName/file_name
folder_path  str!  FolderPath/file_path/folder_path
sha1         str?  SHA1/sha1
file_size    long? FileSize/file_size
initiating_process_file_name str? InitiatingProcessFileName
"""

REGISTRY_VALUE = r"""
action_type  str   ActionType/action = RegistryValueSet
key_path     str!  RegistryKey/key_path
value_name   str?  RegistryValueName/value_name
value_data   str?  RegistryValueData/value_data
initiating_process_file_name str? InitiatingProcessFileName
"""

FIREWALL = r"""
action          str!  DeviceAction/action
protocol        str!  Protocol/protocol
source_port     int!  SourcePort/source_port
dest_port       int!  DestinationPort/dest_port
direction       str   NetworkDirection/direction = Outbound
remote_country  str   RemoteCountry = US
remote_asn      str   RemoteASN = MSFT
bytes_sent      long? SentBytes/bytes_sent
bytes_received  long? ReceivedBytes/bytes_received
vendor          str   DeviceVendor/vendor = fortigate
"""

DNS = r"""
query_name     str!  Name/query_name
query_type     str   QueryType/query_type = A
response_code  str   ResultCode/response_code = 0
resolved_ip    str?  IPAddresses/resolved_ip
"""

PROXY = r"""
url           str!  RequestURL/url
http_method   str!  Method/http_method
http_status   int!  Status/http_status
user_agent    str!  UserAgent/user_agent
content_type  str?  ContentType
"""

SIGNIN = r"""
user_principal_name        str!  UserPrincipalName/user_name/user_principal_name/AccountName
app_display_name           str   AppDisplayName/app_name = Office 365
client_app_used            str   ClientAppUsed/client_app = Browser
result_type                str   ResultType/status = 0
result_description         str?  ResultDescription/failure_reason = Success
mfa_method                 str   MfaMethod hidden = Push
risk_level                 str   RiskLevelDuringSignIn = None
user_agent                 str   UserAgent = Mozilla/5.0
location                   str   Location hidden = US
city                       str   City hidden = Seattle
conditional_access_status  str   ConditionalAccessStatus = success
"""

VPN = r"""
action            str   DeviceAction/action = connect
client_ip         str!  SourceIP/client_ip
assigned_ip       str?  DeviceCustomString1/assigned_ip
session_duration  int?  DeviceCustomNumber1/session_duration = 3600
"""

CLOUD_ACTIVITY = r"""
operation_name  str!  OperationName/operation_name
resource_id     str!  ResourceId/resource_id
caller          str!  Caller/user_identity_type/caller
"""

OFFICE_ACTIVITY = r"""
workload   str!  Workload/workload
operation  str!  Operation/operation
item_type  str!  ItemType/item_type
user_key   str!  UserId/user_key/UserId
client_ip  str   ClientIP/client_ip = 127.0.0.1
"""

CLOUD_APP = r"""
app_name             str!  Application/AppName/app_name
activity_type        str   ActivityType/activity_type = Access
action_type          str!  ActionType/action_type
risk_level           str   RiskLevel/risk_level = None
policy_name          str?  PolicyName/policy_name
app_permissions      str?  AppPermissions/permissions
oauth_consent_scope  str?  OAuthConsentScope/consent_scope
app_id               str?  ApplicationId/AppId/app_id
object_id            str?  ObjectId/object_id
object_name          str?  ObjectName/object_name
object_type          str?  ObjectType/object_type
is_admin_operation   bool  IsAdminOperation = false
is_third_party_app   bool  IsThirdPartyApp = true
country_code         str?  CountryCode/country_code
isp                  str?  ISP/isp
additional_fields    map   AdditionalFields/additional_fields = <map>
"""

IDENTITY_LOGON = r"""
logon_type          str   LogonType/logon_type = Interactive
protocol            str   Protocol/protocol = Kerberos
target_device       str?  TargetDevice/target_device
target_device_ip    str?  TargetDeviceIP/target_ip
logon_result        str   LogonResult/logon_result = Success
failure_reason      str?  FailureReason/failure_reason
is_admin_logon      bool  IsAdminLogon = false
is_service_account  bool  IsServiceAccount = false
account_domain      str?  AccountDomain/account_domain
"""

SERVICE_SIGNIN = r"""
service_principal_name      str?  ServicePrincipalName/service_principal_name/app_name
app_id                      str!  AppId/app_id
resource_id                 str!  ResourceId/resource_id
resource_display_name       str?  ResourceDisplayName/resource_name
result_type                 str   ResultType/status = 0
result_description          str?  ResultDescription/failure_reason = Success
error_code                  int?  ErrorCode
service_principal_id        str?  ServicePrincipalId
user_agent                  str   UserAgent = MicrosoftGraph/1.0
is_service_principal        bool  IsServicePrincipal = true
client_app                  str   ClientAppUsed/client_app = Other
conditional_access_status   str   ConditionalAccessStatus = notApplied
location_details            str?  LocationDetails/location_details
device_detail               str?  DeviceDetail/device_detail
authentication_requirement  str   AuthenticationRequirement/authentication_requirement = singleFactorAuthentication
risk_level_during_signin    str   RiskLevelDuringSignIn/risk_level_during_signin = none
risk_level_aggregated       str   RiskLevelAggregated/risk_level_aggregated = none
authentication_protocol     str   AuthenticationProtocol/authentication_protocol = none
token_issuer_type           str   TokenIssuerType/token_issuer_type = Azure AD
"""

EMAIL = r"""
sender                    str!  SenderFromAddress/SenderFrom/sender/Sender
recipient                 str!  RecipientEmailAddress/Recipient/recipient
subject                   str!  Subject/subject
attachment_verdict        str   AttachmentVerdict/attachment_verdict = NoAttachment
threat_types              str?  ThreatTypes/threat_types
detection_method          str   DetectionMethods/DetectionMethod/detection_method = None
latest_delivery_location  str   LatestDeliveryLocation/delivery_location = Inbox
email_direction           str   EmailDirection/direction = Inbound
spf_pass                  bool  SPFPass hidden = true
dkim_pass                 bool  DKIMPass hidden = true
dmarc_pass                bool  DMARCPass hidden = true
sender_ip                 str?  SenderIP/sender_ip
phish_score               int?  PhishScore
malware_score             int?  MalwareScore
network_message_id        str   NetworkMessageId/network_message_id = <uuid>
internet_message_id       str?  InternetMessageId/internet_message_id
attachment_count          int   AttachmentCount/attachment_count = 0
url_count                 int   UrlCount/url_count = 0
recipient_object_id       str?  RecipientObjectId/recipient_object_id
sender_object_id          str?  SenderObjectId/sender_object_id
sender_display_name       str?  SenderDisplayName/sender_display_name
threat_names              str?  ThreatNames/threat_names
confidence_level          str?  ConfidenceLevel/confidence_level
bulk_complaint_level      int?  BulkComplaintLevel/bulk_complaint_level
email_cluster_id          long? EmailClusterId/email_cluster_id
additional_fields         str?  AdditionalFields/additional_fields
"""

EMAIL_ATTACHMENT = r"""
file_name           str!  FileName/file_name
verdict             str   Verdict/verdict = Clean
sha256              str?  SHA256
network_message_id  str   NetworkMessageId = <uuid>
"""

ALERT = r"""
alert_name          str!   AlertName
alert_type          str    AlertType = MaliciousActivity
description         str?   Description
provider_name       str    ProviderName = <vendor>
product_name        str    ProductName = <vendor>
start_time          time   StartTime = <now>
end_time            time   EndTime = <now>
compromised_entity  str?   CompromisedEntity
entities            str    Entities = []
confidence_level    str    ConfidenceLevel = High
confidence_score    float  ConfidenceScore = 1.0
remediation_steps   str?   RemediationSteps
tactics             str?   Tactics
techniques          str?   Techniques
"""

INCIDENT = r"""
incident_number     str   IncidentNumber = <incident>
title               str!  Title
description         str?  Description
status              str   Status = New
owner               str   Owner = Unassigned
last_modified_time  time  LastModifiedTime = <now>
related_analytic_rule_ids list RelatedAnalyticRuleIds = <list>
"""

DIRECTORY_AUDIT = r"""
operation_name    str!  OperationName/operation_name
category          str   Category = UserManagement
result            str   Result = success
initiated_by      str?  InitiatedBy/initiated_by
target_resources  str?  TargetResources/target_resources
"""

WORKSPACE_AUDIT = r"""
action  str!  Action/action
"""

WEB = r"""
url               str!  RequestURL
http_method       str!  Method
status_code       int!  Status
user_agent        str!  UserAgent
referrer          str?  Referrer
response_time_ms  int!  TimeTaken
"""

SYSLOG = r"""
facility     str   Facility = user
proc         str   ProcessName = system
log_message  str!  Message
"""

DATABASE = r"""
db_name        str!  LogicalServerName
query_text     str!  QueryText
operation      str!  OperationName
rows_affected  int?  NumAffectedRows
status         str   ResultType = success
"""

LINUX = r"""
os_platform      str  OSPlatform = Linux
device_category  str  DeviceCategory = Server
"""

LINUX_AUTH = r"""
pid          int!  ProcessId
proc         str   ProcessName = sshd
log_message  str!  Message
"""

LINUX_SUDO = r"""
pid          int!  ProcessId
user         str!  AccountName
target_user  str   TargetUser = root
command      str!  Command
pwd          str   WorkingDirectory = /home/user
tty          str   TTY = /dev/pts/0
"""

LINUX_AUDIT = r"""
pid         int!  ProcessId
audit_type  str   AuditType = SYSCALL
audit_msg   str!  Message
auid        int   Auid = 1000
ses         int   Session = 1
"""

LINUX_KERNEL = r"""
pid          int   ProcessId = 0
log_message  str!  Message
"""

LINUX_CRON = r"""
pid      int!  ProcessId
user     str   AccountName = root
command  str!  Command
"""

LINUX_PROCESS = r"""
pid   int!  ProcessId
ppid  int   ParentProcessId = 1
exe   str!  Executable
args  str!  CommandLine
uid   int   Uid = 1000
gid   int   Gid = 1000
user  str!  AccountName
"""

MACOS = r"""
os_platform      str  OSPlatform = macOS
device_category  str  DeviceCategory = Workstation
"""

MACOS_LOG = r"""
pid           int!  ProcessId
proc          str!  ProcessName
subsystem     str   Subsystem = com.apple.authd
category      str   Category = default
log_message   str!  Message
sender_image  str   SenderImage = /usr/libexec/authd
"""

MACOS_AUTH = r"""
pid          int!  ProcessId
proc         str   ProcessName = authd
log_message  str!  Message
user         str!  AccountName
"""

MACOS_EXEC = r"""
pid          int!  ProcessId
proc         str   ProcessName = kernel
bundle_id    str!  BundleId
app_path     str!  AppPath
signer       str   Signer = Not signed
log_message  str!  Message
"""
