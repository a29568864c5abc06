"""Schemas of activities and registry tables, always given, never inferred."""

USER = "struct<login:string,id:bigint,gravatar_id:string,type:string,site_admin:boolean,name:string,company:string,email:string,twitter_username:string,organizations:array<struct<login:string,id:bigint,description:string>>>"
COMMENT = f"struct<id:bigint,created_at:string,updated_at:string,author_association:string,body:string,user_data:{USER},assignee_data:{USER}>"
REVIEW_COMMENT = f"struct<id:bigint,diff_hunk:string,commit_id:string,original_commit_id:string,created_at:string,updated_at:string,body:string,user_data:{USER}>"
REVIEW = f"struct<id:bigint,body:string,state:string,author_association:string,submitted_at:string,commit_id:string,user_data:{USER}>"
ACTIVITY = (
    "id bigint, number bigint, __source_path string, __data_type string, created_at string, updated_at string, closed_at string, merged_at string, "
    "state string, title string, body string, author_association string, state_reason string, active_lock_reason string, "
    "merged boolean, locked boolean, mergeable boolean, rebaseable boolean, mergeable_state string, "
    "comments bigint, review_comments bigint, commits bigint, additions bigint, deletions bigint, changed_files bigint, "
    f"user_data {USER}, merged_by_data {USER}, closed_by {USER}, assignee {USER}, assignees array<{USER}>, requested_reviewers_data array<{USER}>, "
    f"comments_data array<{COMMENT}>, review_comments_data array<{REVIEW_COMMENT}>, reviews_data array<{REVIEW}>"
)
DEPENDENCIES = "platform string, project_name string, project_id bigint, dependency_name string, dependency_platform string, dependency_project_id bigint"
DOWNLOADS = "downloads array<struct<day:string,downloads:bigint>>"
